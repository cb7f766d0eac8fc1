"""The word lists, score weights and formats of the matching rules.

Every list below is data, stated as plain text.  Matching code never depends on
the order of a list except where a comment says so.
"""

# --- fixed values: record layouts -------------------------------------------
RAW_FIELDS = ("job_id", "title", "company", "location", "raw_location",
              "location_source", "salary", "description", "apply_link")
CLEANED_FIELDS = RAW_FIELDS + ("dedupe_key",)
KEY_FIELDS = ("title", "company", "location", "description")
LOADED_FIELDS = ("job_id", "title", "company", "location", "raw_location",
                 "location_source", "employment_type", "description", "apply_link")
EMBEDDING_TEXT_FIELDS = ("title", "company", "location", "description")
EMBEDDING_INDEX_FIELDS = ("row_index", "job_id", "title", "company", "location")
EMPLOYEE_COUNT_FIELDS = ("employee_count", "employees", "num_employees",
                         "company_employee_count", "company_size")

# --- fixed values: limits and scales ----------------------------------------
SNAPSHOT_MAX_RECORDS = 50_000
DESCRIPTION_MAX_CHARS = 3_000
COVERAGE_SCAN_CHARS = 1_200
RETRIEVAL_TOP_K = 500
EMBEDDING_BONUS_SCALE = 30
EMBEDDING_SAMPLE_SIZE = 20_000
SAMPLE_SEED = 42
STREAM_BATCH_ROWS = 500
DISPLAY_ROWS = 10
PROFILE_EXCERPT_CHARS = 1_500
CONSTRAINT_PENALTY = 500

# --- fixed values: paths of the raw posting record --------------------------
RAW_PATHS = {
    "job_id": ("idInSource", "_id.$oid"),
    "title": ("json.schemaOrg.title", "position.name", "position", "name"),
    "company": ("orgCompany.name", "json.schemaOrg.hiringOrganization.name"),
    "salary": ("salary", "json.schemaOrg.baseSalary", "json.schemaOrg.estimatedSalary"),
    "description": ("text", "json.schemaOrg.description", "html"),
    "apply_link": ("url", "json.schemaOrg.url"),
}
SCHEMA_ADDRESS_PATH = "json.schemaOrg.jobLocation.address"
SCHEMA_ADDRESS_PARTS = ("addressLocality", "addressRegion", "addressCountry")
SCHEMA_LOCATION_PATH = "json.schemaOrg.jobLocation"
ORG_ADDRESS_PATHS = ("orgAddress.city", "orgAddress.state", "orgAddress.country")
CANDIDATE_FIELD_NAMES = {
    "job title": ("title", "job_title", "jobtitle", "position", "name"),
    "company": ("company", "company_name", "employer", "organization"),
    "location": ("location", "city", "state", "country", "address"),
    "salary": ("salary", "salary_min", "salary_max", "pay", "compensation"),
    "description": ("description", "job_description", "body", "summary"),
    "apply link": ("apply_link", "url", "link", "job_url", "application_url"),
}

# --- fixed values: company size phrases --------------------------------------
TINY_COMPANY_SIGNALS = (
    "startup", "early-stage", "early stage", "seed-stage", "seed stage", "series a",
    "small team", "founding team", "under 50 employees", "under 100 employees",
    "fewer than 100 employees", "less than 100 employees")
LARGE_COMPANY_SIGNALS = (
    "fortune 500", "global company", "multinational", "enterprise", "public company",
    "large-scale", "large scale", "thousands of employees", "worldwide",
    "established company")
ENTERPRISE_SIGNALS = ("fortune 500", "multinational", "worldwide", "thousands of employees")

# --- fixed values: places -----------------------------------------------------
BAY_AREA_TERMS = (
    "bay area", "san francisco", "san jose", "oakland", "palo alto", "mountain view",
    "sunnyvale", "santa clara", "berkeley", "menlo park", "redwood city", "fremont",
    "san mateo")
COVERAGE_BAY_AREA_TERMS = (
    "bay area", "san francisco", "san jose", "oakland", "palo alto", "mountain view",
    "sunnyvale", "santa clara", "berkeley", "menlo park", "redwood city")
REMOTE_TERMS = ("remote", "work from home", "wfh")
HYBRID_TERMS = ("hybrid",)
ONSITE_TERMS = ("onsite", "on-site", "on site")
US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR",
    "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID",
    "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY",
    "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX",
    "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
CANADA_TERMS = (
    "canada", "alberta", "british columbia", "manitoba", "new brunswick",
    "newfoundland", "nova scotia", "ontario", "prince edward island", "quebec",
    "saskatchewan", "toronto", "vancouver", "montreal", "ottawa")
NON_US_CODES = ("au", "ca", "de", "fr", "gb", "ie", "in", "it", "uk")
AMBIGUOUS_CODES = ("ca", "in")
NON_US_TERMS = (
    "australia", "berkshire", "birmingham", "cividate al piano", "county dublin",
    "dublin", "edinburgh", "england", "eu", "europe", "european union", "germany",
    "india", "ireland", "italy", "london", "manchester", "republic of ireland",
    "scotland", "sheffield", "southampton", "sydney", "uk", "united kingdom", "uxbridge")
NON_US_CURRENCY_WORDS = ("pound", "gbp")
NON_US_CURRENCY_SIGN = "£"
US_REMOTE_TERMS = (
    "remote - us", "remote - usa", "remote united states", "remote us", "remote usa",
    "remote within the us", "remote within us", "remote within united states",
    "u.s. based remote", "u.s. remote", "united states remote", "us based remote",
    "us remote", "usa based remote", "usa remote")
REMOTE_ONLY_LOCATIONS = ("remote", "remote remote", "anywhere", "worldwide")
US_ONLY_NAMES = ("us", "usa", "u s", "united states")

# --- fixed values: role, seniority and contract phrases ------------------------
ML_ROLE_HINTS = (
    "ml engineer", "machine learning engineer", "applied scientist", "ai engineer",
    "artificial intelligence engineer", "data scientist")
ML_RELEVANCE_TERMS = (
    "machine learning", " ml ", " ai ", "artificial intelligence", "data scientist",
    "applied scientist", "model", "models", "modeling", "nlp",
    "natural language processing", "deep learning", "pytorch", "tensorflow",
    "scikit-learn", "sklearn")
GENERIC_ROLE_WORDS = ("engineer", "scientist", "analyst", "developer", "manager",
                      "specialist", "associate")
SENIOR_TERMS = ("senior", "sr", "staff", "principal", "lead")
SENIOR_DEALBREAKERS = ("senior", "sr", "staff")
DEFENSE_DEALBREAKERS = ("defense", "military")
YEARS_DEALBREAKERS = ("5+ years", "5 years", "five years")
DEFENSE_TERMS = (
    "defense", "defence", "military", "dod", "department of defense", "army", "navy",
    "air force", "marine corps", "space force", "national security",
    "homeland security", "government contractor", "federal contractor",
    "defense contractor", "aerospace defense", "weapons systems", "mission systems",
    "intelligence community", "clearance", "security clearance", "clearance required",
    "active clearance", "secret clearance", "top secret", "ts/sci", "sci clearance",
    "polygraph", "us citizen required", "u.s. citizenship required",
    "aberdeen proving ground")
DEFENSE_COMPANIES = (
    "dcs corp", "booz allen", "leidos", "raytheon", "rtx", "northrop grumman",
    "lockheed martin", "general dynamics", "bae systems", "saic", "caci", "l3harris",
    "palantir", "anduril")
JUNIOR_TERMS = ("junior", "jr", "entry level", "entry-level", "new grad",
                "early career", "intern", "internship")
MANAGER_TERMS = ("manager", "director", "head", "vp")
CONTRACT_TERMS = (
    "c2c", "contract", "contract duration", "contract-only", "contractor",
    "corp-to-corp", "duration", "freelance", "hourly", "rate open", "rate-open",
    "temp", "temporary", "w2 contract")
TRAINING_TITLE_TERMS = (
    "course", "evaluator", "instructor", "online course", "search engine evaluator",
    "teacher", "training", "tutor")
GENERIC_SOFTWARE_TITLES = (
    ".net developer", "application engineer", "fullstack application engineer",
    "full stack developer", "fullstack developer", "java developer",
    "software developer", "sql developer")
UNPAID_TERMS = ("unpaid", "volunteer", "commission only", "commission-only",
                "commission based")
SPONSORSHIP_NEGATIVE_TERMS = (
    "no sponsorship", "unable to sponsor", "cannot sponsor", "without sponsorship",
    "must be authorized", "must be authorised",
    "authorized to work without sponsorship", "not sponsor", "must be us citizen",
    "us citizenship required")
SPONSORSHIP_POSITIVE_TERMS = (
    "visa", "sponsorship", "h-1b", "h1b", "visa sponsorship", "sponsorship available",
    "immigration", "research lab", "university", "large tech", "global company",
    "opt", "cpt")
COMPANY_PREFERENCE_BONUS = {
    "Prefer tech": ("software", "cloud", "ai", "machine learning", "data", "platform",
                    "technology", "tech"),
    "Prefer healthcare": ("health", "healthcare", "hospital", "clinical", "medical",
                          "patient", "pharma", "biotech"),
    "Prefer large companies": ("global", "enterprise", "fortune", "corporation", "inc",
                               "technologies", "group"),
    "Avoid tiny startups": (),
    "Prefer research labs": ("research", "lab", "laboratory", "university",
                             "institute", "scientist", "science"),
}
COMPANY_PREFERENCE_PENALTY = {
    "Prefer tech": (),
    "Prefer healthcare": (),
    "Prefer large companies": ("startup", "seed stage", "early stage"),
    "Avoid tiny startups": ("startup", "seed stage", "early stage", "founding",
                            "stealth"),
    "Prefer research labs": (),
}
YEAR_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
              "seven": 7, "eight": 8, "nine": 9, "ten": 10}

# --- fixed values: role families (dict order is the order of evaluation) -------
ROLE_TARGET_TERMS = {
    "ml_ai": ("ml engineer", "machine learning engineer", "machine learning",
              "applied scientist", "ai engineer", "artificial intelligence",
              "data scientist"),
    "analytics": ("data analyst", "bi analyst", "business analyst",
                  "analytics engineer", "business intelligence"),
    "mlops_infra": ("mlops", "mlops engineer", "ml platform", "ml platform engineer",
                    "infrastructure engineer", "platform engineer",
                    "senior ml engineer", "senior machine learning engineer"),
    "research": ("research scientist", "applied scientist", "ai researcher",
                 "ai research"),
}
ROLE_POSITIVE_TERMS = {
    "ml_ai": ("machine learning", "ml engineer", "ai engineer", "applied scientist",
              "data scientist", "modeling", "model deployment", "model serving", "nlp",
              "deep learning", "pytorch", "tensorflow", "scikit-learn", "sklearn",
              "mlops", "artificial intelligence"),
    "analytics": ("data analyst", "bi analyst", "analytics engineer",
                  "business intelligence", "sql", "tableau", "dashboard", "dashboards",
                  "reporting", "data analysis", "power bi"),
    "mlops_infra": ("mlops", "ml platform", "ml infrastructure",
                    "machine learning platform", "production ml",
                    "production machine learning", "kubernetes", "docker", "spark",
                    "kafka", "cloud", "aws", "gcp", "azure", "deployment",
                    "model deployment", "model serving", "infrastructure",
                    "microservices"),
    "research": ("research scientist", "applied scientist", "ai research", "nlp",
                 "computer vision", "deep learning", "publication", "publications",
                 "phd", "lab", "laboratory"),
}
ROLE_NEGATIVE_TERMS = {
    "ml_ai": ("tutor", "expert", "course", "online course", "instructor", "teacher",
              "trainer", "search engine evaluator", "social media evaluator",
              "financial analyst", "marketing analyst", "business analyst",
              "reconciliations analyst", "payment processor", "bi developer",
              "reporting analyst", "accounting", "sales"),
    "analytics": ("tutor", "course", "online course", "instructor", "teacher", "sales",
                  "payment processing", "payment processor", "driver", "warehouse"),
    "mlops_infra": ("data scientist", "research scientist", "data analyst",
                    "business analyst", "financial analyst", "marketing analyst",
                    "reporting analyst"),
    "research": ("sales", "marketing analyst", "financial analyst",
                 "payment processor", "tutor"),
}
SPECIALIST_FAMILIES = ("ml_ai", "mlops_infra", "research")
INFERRED_FAMILY_TERMS = {
    "ml_ai": ROLE_POSITIVE_TERMS["ml_ai"],
    "analytics_bi": ROLE_POSITIVE_TERMS["analytics"],
    "software": ("software engineer", "backend", "frontend", "full stack", "developer",
                 "java", "python", "javascript"),
    "mlops_infra": ROLE_POSITIVE_TERMS["mlops_infra"],
    "product_pm": ("product manager", "project manager", "program manager",
                   "product owner", "scrum"),
    "business_finance_ops": ("business analyst", "financial analyst",
                             "operations analyst", "strategy", "consulting",
                             "supply chain"),
    "marketing_sales": ("marketing analyst", "growth", "sales", "account manager",
                        "customer success"),
    "design_ux": ("ux", "ui", "product designer", "user research", "visual designer"),
    "research_science": ROLE_POSITIVE_TERMS["research"],
}

# --- fixed values: preference options -------------------------------------------
NO_PREFERENCE = "No preference"
ENTRY_ONLY = "Entry-level / New Grad only"
JUNIOR_TO_MID = "Junior to Mid-level"
MID_TO_SENIOR = "Mid to Senior allowed"
SENIOR_PREFERRED = "Senior+ preferred"
EXCLUDE_SENIOR = "Exclude Senior/Staff/Principal"
EXCLUDE_JUNIOR = "Exclude Junior/Entry-level"
AVOIDS_SENIOR = (ENTRY_ONLY, JUNIOR_TO_MID, EXCLUDE_SENIOR)
AVOIDS_JUNIOR = (MID_TO_SENIOR, SENIOR_PREFERRED, EXCLUDE_JUNIOR)
AVOIDS_INTERNSHIP = (SENIOR_PREFERRED, EXCLUDE_JUNIOR)
PREFER_SMALL = "Prefer small companies"
PREFER_MEDIUM = "Prefer medium companies"
PREFER_LARGE = "Prefer large companies"
EXCLUDE_TINY = "Exclude tiny startups"
LARGE_ONLY = "Large companies only"

# --- fixed values: feedback ------------------------------------------------------
FEEDBACK_IGNORED_TERMS = ("aws", "cloud", "data", "engineer", "engineering",
                          "full_time", "machine", "ml", "python", "software")
TITLE_STOP_WORDS = ("and", "the", "for", "with", "remote", "senior", "junior", "lead",
                    "staff", "principal")
REWARDS = {"Accept": 1, "Skip": 0, "Reject": -1}
RELEVANCE = {"Accept": 2, "Skip": 1, "Reject": 0}

# --- fixed values: analytics -----------------------------------------------------
ANALYTICS_SKILLS = {
    "Python": ("python",), "SQL": ("sql",), "Java": ("java",),
    "JavaScript": ("javascript",), "R": ("r",), "Excel": ("excel",),
    "Tableau": ("tableau",), "Power BI": ("power bi",), "AWS": ("aws",),
    "Azure": ("azure",), "GCP": ("gcp", "google cloud"), "Spark": ("spark",),
    "PySpark": ("pyspark",), "Kafka": ("kafka",), "Kubernetes": ("kubernetes",),
    "Docker": ("docker",), "TensorFlow": ("tensorflow",), "PyTorch": ("pytorch",),
    "Machine Learning": ("machine learning",),
    "NLP": ("nlp", "natural language processing"),
    "Data Warehouse": ("data warehouse", "data warehousing"), "ETL": ("etl",),
    "Airflow": ("airflow",), "Snowflake": ("snowflake",),
    "Databricks": ("databricks",), "React": ("react", "react.js", "reactjs"),
    "Node.js": ("node.js", "nodejs"), "C#": ("c#",), ".NET": (".net",),
}
SALARY_BANDS = (("< $80K", 80_000), ("$80K-$120K", 120_000),
                ("$120K-$160K", 160_000), ("$160K-$200K", 200_000))
SALARY_BAND_TOP = "$200K+"
SALARY_BAND_UNKNOWN = "Unknown / Not disclosed"
SALARY_BAND_ORDER = (SALARY_BAND_UNKNOWN, "< $80K", "$80K-$120K", "$120K-$160K",
                     "$160K-$200K", "$200K+")
ANNUAL_PERIODS = ("year", "yearly", "annual", "annually")
NO_SALARY_TEXTS = ("unknown", "none", "nan", "null", "depends on experience",
                   "competitive salary")
NON_ANNUAL_WORDS = ("hour", "hourly", "per hour", "month", "monthly", "per month",
                    "week", "weekly", "day", "daily")
MISSING_LOCATION_TEXTS = ("unknown", "nan", "none", "null")

# --- fixed values: coverage groups -------------------------------------------------
COVERAGE_GROUPS = {
    "ML/AI": ("machine learning", "ml engineer", "ai engineer",
              "artificial intelligence", "applied scientist", "data scientist",
              "pytorch", "tensorflow", "scikit-learn", "nlp", "deep learning"),
    "Analytics": ("data analyst", "business analyst", "bi analyst",
                  "business intelligence", "analytics engineer", "tableau",
                  "dashboard", "reporting", "sql"),
    "MLOps / Infrastructure": ("mlops", "ml platform", "kubernetes", "docker", "spark",
                               "kafka", "aws", "gcp", "azure", "microservices",
                               "model serving"),
    "Research": ("research scientist", "applied scientist", "ai research",
                 "computer vision", "nlp", "publication", "lab", "phd"),
    "Visa / Sponsorship": ("h-1b", "h1b", "sponsorship", "visa", "immigration", "opt",
                           "cpt"),
    "Contract / Temp": ("contract", "contractor", "temporary", "temp"),
    "Seniority": ("senior", "sr", "staff", "principal", "lead", "director", "manager",
                  "junior", "entry level", "intern"),
}
COVERAGE_METRICS = ("total jobs", "jobs with known salary", "US jobs", "remote jobs",
                    "California / Bay Area jobs") + tuple(COVERAGE_GROUPS)
COMPARISON_METRICS = ("ML/AI", "Analytics", "MLOps / Infrastructure", "Research")
FULL_DATASET = "Full cleaned dataset"
SUBSET_DATASET = "Embedded subset"

# --- fixed values: sampling buckets (dict order is the order of selection) ----------
SAMPLE_BUCKETS = {
    "ml_ai_data_science": ("machine learning", "ml engineer", "artificial intelligence",
                           "ai engineer", "applied scientist", "deep learning",
                           "pytorch", "tensorflow", "nlp", "computer vision",
                           "data scientist"),
    "data_analytics_bi": ("data analyst", "business intelligence", "bi developer",
                          "analytics engineer", "sql", "tableau", "power bi"),
    "software_engineering": ("software engineer", "backend", "frontend", "full stack",
                             "developer", "java", "python", "javascript"),
    "infra_cloud_devops": ("devops", "cloud engineer", "site reliability", "sre",
                           "kubernetes", "docker", "aws", "azure", "gcp",
                           "data platform", "mlops"),
    "product_project_management": ("product manager", "project manager",
                                   "program manager", "product owner", "scrum"),
    "business_finance_operations": ("business analyst", "financial analyst",
                                    "operations analyst", "strategy", "consulting",
                                    "supply chain"),
    "marketing_sales_customer": ("marketing analyst", "growth", "sales",
                                 "account manager", "customer success"),
    "design_ux": ("ux", "ui", "product designer", "user research", "visual designer"),
    "research_science": ("researcher", "research scientist", "scientist",
                         "quantitative researcher"),
}
GENERAL_BUCKET = "general_random"

# --- fixed values: candidate documents ----------------------------------------------
SKILL_VOCABULARY = (
    "Python", "SQL", "R", "Excel", "Tableau", "Power BI", "pandas", "NumPy",
    "scikit-learn", "PyTorch", "TensorFlow", "Spark", "PySpark", "Kafka", "AWS", "GCP",
    "Azure", "machine learning", "deep learning", "NLP", "computer vision",
    "data analysis", "dashboarding", "A/B testing", "regression", "optimization",
    "statistics", "forecasting", "ETL", "data engineering", "business intelligence")
SKILL_DISPLAY_NAMES = {
    "a/b testing": "A/B Testing", "airflow": "Airflow", "aws": "AWS", "gcp": "GCP",
    "etl": "ETL", "ml": "ML", "ml infrastructure": "ML Infrastructure",
    "ml platform": "ML Platform", "mlops": "MLOps",
    "model deployment": "Model Deployment", "model serving": "Model Serving",
    "nlp": "NLP", "numpy": "NumPy", "pandas": "pandas", "power bi": "Power BI",
    "pyspark": "PySpark", "pytorch": "PyTorch", "production ml": "Production ML",
    "scikit-learn": "scikit-learn", "sql": "SQL", "tensorflow": "TensorFlow",
    "tensorflow serving": "TensorFlow Serving", "terraform": "Terraform",
}
SKILL_NOISE_WORDS = ("certified", "some")
PREVIEW_HEADINGS = (
    "Profile", "Summary", "Objective", "Skills", "Technical Skills", "Work Experience",
    "Professional Experience", "Experience", "Education", "Projects", "Certifications")
SUMMARY_HEADINGS = ("Summary", "Profile", "Objective")
SKILLS_HEADINGS = ("Skills", "Technical Skills")
EXPERIENCE_HEADINGS = ("Experience", "Work Experience", "Professional Experience")
PROJECT_HEADINGS = ("Projects", "Education", "Certifications")
SEMANTIC_SECTIONS = ("background", "skills", "technical skills", "experience",
                     "projects", "education")
SEMANTIC_EXCLUDED = ("target role", "target roles", "preferences", "preference",
                     "dealbreakers", "dealbreaker", "salary", "location preference",
                     "visa preference", "constraints")
NEGATIVE_LINE_STARTS = (
    r"no\s+senior\b", r"no\s+staff\b", r"no\s+manager\b", r"no\s+director\b",
    r"no\s+5\+?\s*years\b", r"no\s+defense\b", r"no\s+military\b",
    r"no\s+clearance\b", r"no\s+dod\b")
EVIDENCE_EXCLUDED = ("dealbreakers", "pass criteria", "preferences", "preference",
                     "target role", "target roles", "tailoring notes")
EVIDENCE_SECTIONS = EVIDENCE_EXCLUDED + (
    "background", "certifications", "education", "experience", "projects", "skills",
    "summary", "technical skills", "work experience")
BACKGROUND_EXCLUDED = ("background", "candidate name", "dealbreakers", "pass criteria",
                       "persona", "preferences", "skills", "target role",
                       "target roles")
BACKGROUND_HEADINGS = BACKGROUND_EXCLUDED + (
    "certifications", "education", "experience", "projects", "summary",
    "work experience")
BACKGROUND_FALLBACK = "[Add a 1-2 sentence background summary from your resume.]"
NAME_FALLBACK = "[Add your name]"
BACKGROUND_EVIDENCE = (
    r"\bbackground\b",
    r"\b(?:bachelor|bachelors|bs|ba|master|masters|ms|msba|mba|phd|degree)\b",
    r"\b(?:university|college|school|graduate|graduating|student)\b",
    r"\b\d+\+?\s+years?\b",
    r"\b(?:year|years)\s+(?:of|in)\s+experience\b",
    r"\b(?:intern|internship|internships)\b",
    r"\b(?:career transition|career pivot|pivot|transition|move to|moving to)\b",
    r"\b(?:opt|h-?1b|visa|sponsorship)\b",
    r"\b(?:engineer|analyst|scientist|researcher|developer|manager)\b")
NOISE_LABELS = (
    "background", "candidate name", "certifications", "dealbreakers", "education",
    "experience", "pass criteria", "preferences", "projects", "summary", "skills",
    "target role", "target roles", "work experience")
EVIDENCE_VERBS = (
    "analyzed", "built", "created", "designed", "developed", "implemented", "improved",
    "led", "managed", "modeled", "optimized", "project", "published", "researched",
    "supported", "transformed", "worked")
INFRA_SKILLS = (
    "aws", "azure", "cloud", "cloud infrastructure", "airflow", "data pipeline",
    "databricks", "docker", "feature pipeline", "gcp", "kafka", "kubernetes",
    "microservices", "ml infrastructure", "ml platform", "mlflow", "mlops",
    "model deployment", "model serving", "production ml", "spark",
    "tensorflow serving", "terraform")
SUPPORTED_SKILL_TERMS = (
    "airflow", "aws", "azure", "cloud", "cloud infrastructure", "data pipeline",
    "databricks", "docker", "feature pipeline", "gcp", "java", "kafka", "kubernetes",
    "microservices", "ml infrastructure", "ml platform", "mlflow", "mlops",
    "model deployment", "model serving", "production ml", "spark",
    "tensorflow serving", "terraform")
INFRA_CONTEXT_TERMS = (
    "ai infrastructure", "machine learning infrastructure",
    "machine learning platform", "ml infrastructure", "ml platform", "mlops",
    "model deployment", "model serving", "production machine learning",
    "production ml")

# --- fixed values: export layouts ------------------------------------------------------
USER_EXPORT_COLUMNS = ("rank", "title", "company", "location", "salary_text",
                       "description", "apply_url", "final_score", "matched_skills",
                       "match_explanation")
DISPLAY_COLUMNS = {
    "rank": "Rank", "title": "Job Title", "company": "Company",
    "location": "Location", "salary_text": "Salary",
    "required_years_min": "Required Years",
    "employment_type_inferred": "Employment Type",
    "company_size_inferred": "Company Size", "matched_skills": "Matched Skills",
    "match_score": "Match Score",
}
DEBUG_COLUMNS = (
    "rank", "title", "company", "location", "preferred_location",
    "location_strictness", "seniority_preference", "salary_minimum",
    "salary_strictness", "max_required_years_setting", "company_size_preference",
    "company_size_inferred", "company_size_confidence", "company_size_match_text",
    "is_tiny_startup", "is_small_company", "is_medium_company", "is_large_company",
    "is_enterprise_company", "passes_company_size_filter", "location_source",
    "location_confidence", "is_us_location", "is_remote", "is_us_remote_location",
    "has_explicit_non_us_location_signal", "is_hybrid", "is_bay_area",
    "is_non_us_location", "passes_location_filter", "location_filter_reason",
    "required_years_min", "years_requirement_text", "passes_years_filter",
    "employment_type_inferred", "is_contract_or_temp", "is_unpaid_or_commission",
    "passes_contract_filter", "passes_unpaid_filter", "passes_salary_filter",
    "active_constraint_filters", "is_senior_staff_principal",
    "is_junior_entry_level", "is_manager_director", "passes_seniority_filter",
    "passes_internship_filter", "is_defense_military_clearance",
    "defense_match_text", "passes_defense_filter", "has_visa_sponsorship_signal",
    "has_no_sponsorship_signal", "role_fit_score", "passes_role_fit_filter",
    "embedding_similarity", "feedback_label", "feedback_adjustment_score",
    "adjusted_final_score", "passes_all_active_constraints")
