"""Document functions: lines, headed sections and evidence, inside one row.

A document is an array of lines.  Headings are found by position, and a section
is the slice between two headings, so nothing is exploded, shuffled or windowed:
each document stays in its row however many lines it has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions.text import (LINE_BREAK, WHITESPACE, clean_ws, contains_any,
                                      dictionary_sql, let, norm_search,
                                      split_keywords, string_array, strip, text_or_empty)

# all but a-z and the blank, and all but what headings consist of, as plain ranges
NO_LETTER = r"[\x00-\x1f!-`{-\x{10FFFF}]+"
NO_HEADING = r"[\x00-\x1f!-*,.:-`{-\x{10FFFF}]+"
_PERSONA = r"(?iU)^persona(?:\s+\d+)?\b"


def raw_lines(text: Column) -> Column:
    return F.split(text_or_empty(text), LINE_BREAK)


def lines(text: Column) -> Column:
    """Non-empty lines with white space collapsed."""
    return F.filter(F.transform(raw_lines(text), clean_ws), lambda x: x != "")


def stripped_lines(text: Column) -> Column:
    """Non-empty lines, trimmed at the ends only."""
    return F.filter(F.transform(raw_lines(text), strip), lambda x: x != "")


def _no_colons(c: Column) -> Column:
    return F.rtrim(c, F.lit(":"))


def _trim_marks(c: Column) -> Column:
    return F.btrim(c, F.lit(" -•\t"))


def _is_persona(c: Column) -> Column:
    # the pattern is only tried on lines that can match
    return (c.startswith("p") | c.startswith("P")) & c.rlike(_PERSONA)


def _before_colon(c: Column) -> Column:
    return F.substring_index(c, ":", 1)


def _after_colon(c: Column) -> Column:
    return F.substr(c, F.length(_before_colon(c)) + 2)


def sections(line_array: Column, heading: Callable[[Column], Column],
             remainder: Callable[[Column, Column], Column]) -> Column:
    """Cut lines into array<struct<heading, remainder, lines>>.

    Lines before the first heading form a leading section with heading ''.
    ``heading`` gives the heading of a line or NULL; ``remainder`` what is left of
    the heading line itself.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("line"), F.lit("").alias("heading"))

    def cut(every: Column) -> Column:
        marked = F.concat(F.array(start), F.filter(
            F.transform(every, lambda x, i: F.struct(
                (i + 1).alias("at"), x.alias("line"), heading(x).alias("heading"))),
            lambda m: m["heading"].isNotNull()))

        def between(marks: Column) -> Column:
            ends = F.concat(F.transform(F.slice(marks, 2, F.size(marks)), lambda m: m["at"]),
                            F.array(F.size(every) + 1))
            return let(ends, lambda end: F.transform(marks, lambda m, j: F.struct(
                m["heading"].alias("heading"),
                F.when(m["at"] > 0, remainder(m["line"], m["heading"])).otherwise("")
                .alias("remainder"),
                F.slice(every, m["at"] + 1, F.get(end, j) - m["at"] - 1).alias("lines"))))

        return let(marked, between)

    return let(line_array, cut)


# --- headed sections (preview headings) -------------------------------------------

def preview_heading(line: Column) -> Column:
    """Known heading that a line starts with, longest first; NULL when none."""
    def of(normal: Column) -> Column:
        found = F.lit(None).cast("string")
        for name in sorted(V.PREVIEW_HEADINGS, key=len):
            low = name.lower()
            found = F.when((normal == low) | normal.startswith(low + " "), name).otherwise(found)
        return found

    return let(F.trim(F.regexp_replace(F.lower(line), NO_LETTER, "")), of)


def without_heading(line: Column, heading: Column) -> Column:
    """Drop a leading heading, an optional colon and blanks, whatever the case."""
    bare = F.regexp_replace(line, r"^\s+", "")
    is_prefix = F.startswith(F.lower(bare), F.lower(heading))
    rest = F.regexp_replace(F.substr(bare, F.length(heading) + 1), r"^\s*:?\s*", "")
    return F.trim(F.when(is_prefix, rest).otherwise(line))


def headed_sections(text: Column) -> Column:
    """map<heading, text> of the known headings; a repeated heading continues."""
    def as_map(parts: Column) -> Column:
        def body(name: Column) -> Column:
            own = F.filter(parts, lambda s: s["heading"] == name)
            return F.array_join(F.flatten(F.transform(own, lambda s: F.concat(
                F.filter(F.array(s["remainder"]), lambda r: r != ""), s["lines"]))), "\n")

        names = F.array_distinct(F.transform(parts, lambda s: s["heading"]))
        return let(names, lambda n: F.map_from_arrays(n, F.transform(n, body)))

    return let(F.filter(sections(stripped_lines(text), preview_heading, without_heading),
                        lambda s: s["heading"] != ""), as_map)


def first_section(section_map: Column, headings: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(section_map, F.lit(h)), F.lit(""))
                        for h in headings], F.lit(""))


# --- semantic text -------------------------------------------------------------------

def _normal_heading(line: Column) -> Column:
    kept = F.regexp_replace(F.lower(_no_colons(strip(line))), NO_HEADING, "")
    return F.trim(F.regexp_replace(kept, " +", " "))


_SEMANTIC_HEADINGS = V.SEMANTIC_SECTIONS + V.SEMANTIC_EXCLUDED


def inline_heading(line: Column) -> Column:
    """Known heading in front of the first colon, else NULL."""
    return F.when(line.contains(":"), let(
        _normal_heading(_before_colon(line)),
        lambda name: F.when(name.isin(list(_SEMANTIC_HEADINGS)), name)))


def line_heading(line: Column) -> Column:
    """Heading of a line: known, in front of a colon, or short and ending in ':'."""
    return F.coalesce(inline_heading(line), let(_normal_heading(line), lambda name: F.when(
        name.isin(list(_SEMANTIC_HEADINGS)) | _short_heading(line), name)))


def _short_heading(line: Column) -> Column:
    return let(strip(line), lambda own: own.endswith(":") & (F.length(own) <= 40))


def is_heading(line: Column) -> Column:
    return _normal_heading(line).isin(list(_SEMANTIC_HEADINGS)) | _short_heading(line)


def negative_line(line: Column) -> Column:
    start = F.regexp_replace(strip(F.lower(line)), "^[^a-z0-9]+", "")
    # all these starts begin with "no"
    return let(start, lambda s: s.startswith("no") & s.rlike(
        "(?U)^(?:" + "|".join(V.NEGATIVE_LINE_STARTS) + ")"))


def semantic_text(text: Column) -> Column:
    """Relevant sections without preferences, exclusions and negative lines.

    Until the first relevant heading, lines outside excluded sections are kept;
    from then on only relevant sections are.
    """
    parts = sections(lines(text), line_heading, lambda x, _h: F.when(
        inline_heading(x).isNotNull(), strip(_after_colon(x))).otherwise(""))
    relevant = list(V.SEMANTIC_SECTIONS)

    def join_kept(every: Column) -> Column:
        first = F.array_position(
            F.transform(every, lambda s: s["heading"].isin(relevant)), True)
        return let(first, lambda f: F.array_join(
            F.flatten(F.transform(every, lambda s, i: kept(s, i, f))), "\n"))

    def kept(s: Column, i: Column, first: Column) -> Column:
        is_relevant = s["heading"].isin(relevant)
        open_part = (first == 0) | (i + 1 < first)
        body = F.when(is_relevant | (open_part & ~s["heading"].isin(list(V.SEMANTIC_EXCLUDED))),
                      s["lines"]).otherwise(string_array([]))
        head = F.when(is_relevant & (s["remainder"] != ""),
                      F.array(s["remainder"])).otherwise(string_array([]))
        return F.filter(F.concat(head, body), lambda x: ~negative_line(x))

    return let(parts, join_kept)


def profile_text(role: Column, skills: Column, excerpt: Column,
                 max_chars: int = V.PROFILE_EXCERPT_CHARS) -> Column:
    """Profile text for embedding; parts without content are left out.

    A part counts as empty when nothing follows its first colon.
    """
    cut = strip(F.substring(text_or_empty(excerpt), 1, max_chars))
    parts = [("Target role: ", strip(text_or_empty(role))),
             ("Skills: ", strip(text_or_empty(skills))), ("Resume excerpt: ", cut)]
    return F.concat_ws("\n", *[F.when(body != "", F.concat(F.lit(label), body))
                               for label, body in parts])


# --- candidate evidence -----------------------------------------------------------------

def evidence_lines_of(text: Column) -> Column:
    """Lines outside target, preference and dealbreaker sections."""
    known = list(V.EVIDENCE_SECTIONS)

    def heading(x: Column) -> Column:
        head = let(F.lower(strip(_before_colon(x))), lambda h: F.when(h.isin(known), h))
        whole = let(F.lower(strip(_no_colons(x))), lambda w: F.when(w.isin(known), w))
        return F.coalesce(F.when(x.contains(":"), head), whole)

    def content(x: Column, _h: Column) -> Column:
        return F.when(x.contains(":"), strip(_after_colon(x))).otherwise("")

    kept_lines = F.filter(lines(text), lambda x: ~_is_persona(x))
    parts = F.filter(sections(kept_lines, heading, content),
                     lambda s: ~s["heading"].isin(list(V.EVIDENCE_EXCLUDED)))
    return F.flatten(F.transform(parts, lambda s: F.concat(
        F.filter(F.array(s["remainder"]), lambda r: r != ""), s["lines"])))


def evidence_text(text: Column) -> Column:
    return F.array_join(evidence_lines_of(text), "\n")


def supported_skills(skills: Column, evidence: Column) -> Column:
    """Sorted union of typed skills and known terms found in the evidence."""
    known = F.expr(dictionary_sql(V.SUPPORTED_SKILL_TERMS))
    found = let(norm_search(evidence), lambda normal: F.transform(
        F.filter(known, lambda d: F.contains(normal, d["form"])), lambda d: d["term"]))
    return F.array_sort(F.array_union(split_keywords(skills), found))


def background(text: Column) -> Column:
    """At most three background lines, joined, 500 characters, or the fallback."""
    return let(F.transform(lines(text), _trim_marks), _background_of)


def _background_of(every: Column) -> Column:
    def normal(x: Column) -> Column:
        return F.lower(strip(_no_colons(x)))

    labelled = [h for h in V.BACKGROUND_EXCLUDED if h != "background"]

    def heading(x: Column) -> Column:
        return let(normal(x), lambda n: F.when(n.isin(list(V.BACKGROUND_HEADINGS)), n)
                   .when(n.contains(":") & n.rlike("^(?:" + "|".join(labelled) + "):"), "label")
                   .when(n.startswith("background:"), "background"))

    def content(x: Column, _h: Column) -> Column:
        return F.when(normal(x).startswith("background:"),
                      strip(_after_colon(x))).otherwise("")

    body = F.filter(every, lambda x: ~_is_persona(x))
    parts = F.filter(sections(body, heading, content),
                     lambda s: s["heading"].isin("background", "summary"))
    # a line given right behind "Background:" does not stop the search at three
    from_sections = _first_background_lines(parts)
    patterns = "(?iU)" + "|".join(V.BACKGROUND_EVIDENCE)
    from_patterns = F.slice(F.filter(
        F.slice(every, 2, 19),
        lambda x: ~normal(x).isin(list(V.BACKGROUND_EXCLUDED)) & ~_is_persona(x)
        & x.rlike(patterns)), 1, 3)

    def unique(cleaned: Column) -> Column:
        return let(F.transform(cleaned, F.lower), lambda keys: F.filter(
            F.transform(cleaned, lambda x, i: F.when(
                F.array_position(keys, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull()))

    chosen = let(from_sections, lambda own: F.when(F.size(own) > 0, own)
                 .otherwise(from_patterns))
    cleaned = F.filter(
        F.transform(chosen, lambda x: strip(F.regexp_replace(
            x, r"(?i)^(?:background|summary)\s*:\s*", ""))),
        lambda x: (x != "") & ~F.lower(x).isin(list(V.BACKGROUND_EXCLUDED)))
    joined = strip(F.substring(F.array_join(let(cleaned, unique), " "), 1, 500))
    return let(joined, lambda t: F.when(t == "", V.BACKGROUND_FALLBACK).otherwise(t))


def _first_background_lines(parts: Column) -> Column:
    """Lines up to the first body line that makes it three.

    Content behind "Background:" is always taken; the search only stops when a
    body line is added, so two such contents in a row can give more than three.
    """
    flagged = F.flatten(F.transform(parts, lambda s: F.concat(
        F.transform(F.filter(F.array(s["remainder"]), lambda r: r != ""),
                    lambda r: F.struct(r.alias("line"), F.lit(False).alias("body"))),
        F.transform(s["lines"], lambda x: F.struct(x.alias("line"),
                                                   F.lit(True).alias("body"))))))

    def until_three(rows: Column) -> Column:
        stops = F.filter(F.transform(rows, lambda f, i: F.when(
            f["body"] & (i >= 2), i + 1)), lambda i: i.isNotNull())
        return F.transform(F.slice(rows, 1, F.coalesce(F.get(stops, 0), F.size(rows))),
                           lambda f: f["line"])

    return let(flagged, until_three)


def candidate_name(text: Column) -> Column:
    """First non-empty line, at most 80 characters."""
    return F.coalesce(F.substring(F.get(lines(text), 0), 1, 80), F.lit("Unknown"))


def clean_name(name: Column) -> Column:
    """Person behind a persona card header; other names stay as they are."""
    original = clean_ws(name)
    pieces = F.filter(F.transform(F.split(original, r" +(?:—|–|-) +"), lambda p: F.trim(p)),
                      lambda p: p != "")
    return F.when(F.lower(original).isin("", "unknown", "nan", "none"), V.NAME_FALLBACK) \
        .when(_is_persona(original) & (F.size(pieces) >= 2), F.get(pieces, 1)) \
        .otherwise(original)


def action_lines(text: Column, name: Column, background_text: Column, skills: Column) -> Column:
    """Lines that show an action and are not structure; they do not depend on a posting."""
    known = F.transform(skills, F.lower)
    low_name = F.lower(strip(name))
    low_background = F.lower(background_text)
    labels = list(V.NOISE_LABELS)

    def noisy(x: Column) -> Column:
        low = F.lower(_no_colons(x))
        label_start = low.rlike("^(?:" + "|".join(labels) + "):")
        parts = F.filter(F.transform(F.split(x, ","), lambda p: F.lower(strip(p))),
                         lambda p: p != "")
        listed = F.size(F.filter(parts, lambda p: F.array_contains(known, p)))
        return (x == "") | _is_persona(x) | low.isin(labels) | label_start \
            | (low == low_name) \
            | ((low_background != "") & F.contains(low_background, low)) \
            | ((F.size(parts) >= 2) & (listed >= 2))

    verbs = r"(?iU)\b(?:" + "|".join(V.EVIDENCE_VERBS) + r")\b"
    candidates = F.transform(evidence_lines_of(text), _trim_marks)
    return F.filter(candidates, lambda x: x.rlike(verbs) & ~noisy(x))


def evidence_lines(actions: Column, keywords: Column, limit: int = 4) -> Column:
    """First action lines with a keyword of the pair."""
    wanted = F.transform(keywords, F.lower)
    return F.slice(F.filter(actions, lambda x: F.exists(
        wanted, lambda k: F.contains(F.lower(x), k))), 1, limit)


# --- preview --------------------------------------------------------------------------------

def _break_names() -> list[str]:
    """Headings that get a line of their own.

    Headings are set apart in the order of their list, so one that holds an earlier one behind
    its first word is parted by that one and found no more.
    """
    names = [n.lower() for n in V.PREVIEW_HEADINGS]
    return [n for i, n in enumerate(names)
            if not any(n.endswith(" " + m) or f" {m} " in n for m in names[:i])]


def _before_headings() -> str:
    """Place in front of a heading that does not begin a line, for all headings in one pass.

    First letters are compared before anything else; the long s is the only other character
    that is equal to one of them whatever the case.
    """
    names = _break_names()
    first = "".join(sorted({c for n in names for c in (n[0], n[0].upper())}))
    return rf"(?=[{first}\u017f])(?<!\n)(?iU:(?=\b(?:{'|'.join(names)})\b))"


def tidy(text: Column) -> Column:
    """Text without empty lines, with every known heading on its own line."""
    t = F.regexp_replace(text_or_empty(text), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?U)\n\s*\n+", "\n\n")
    t = F.regexp_replace(t, _before_headings(), "\n\n")
    return F.array_join(F.filter(F.transform(raw_lines(t), strip), lambda x: x != ""), "\n")


def cut_preview(tidied: Column, max_chars: int = 1_500) -> Column:
    return F.when(F.length(tidied) > max_chars, F.concat(
        F.regexp_replace(F.substring(tidied, 1, max_chars), f"{WHITESPACE}\\z", ""),
        F.lit("\n\n[Preview trimmed]"))).otherwise(tidied)


def preview(text: Column, max_chars: int = 1_500) -> Column:
    """Tidy text with every known heading on its own line, trimmed to a length."""
    return let(tidy(text), lambda t: cut_preview(t, max_chars))


def trim_words(c: Column, limit: int) -> Column:
    return let(c, lambda t: let(
        F.filter(F.split(t, WHITESPACE), lambda w: w != ""),
        lambda words: F.when(F.size(words) <= limit, strip(t)).otherwise(
            F.concat(F.array_join(F.slice(words, 1, limit), " "), F.lit("...")))))


def header_preview(text: Column, limit: int = 4) -> Column:
    """Lines in front of the first heading, at most ``limit``."""
    first = F.get(sections(stripped_lines(text), preview_heading, without_heading), 0)
    return F.array_join(F.slice(first["lines"], 1, limit), "\n")


def preview_sections(section_map: Column, cleaned: Column) -> Column:
    """map<title, text> of the short preview sections that have content."""
    experience = first_section(section_map, V.EXPERIENCE_HEADINGS)
    entries = [
        ("Header / Candidate Info", header_preview(cleaned)),
        ("Summary", trim_words(first_section(section_map, V.SUMMARY_HEADINGS), 70)),
        ("Skills", trim_words(first_section(section_map, V.SKILLS_HEADINGS), 80)),
        ("Experience Preview", F.when(experience != "", trim_words(experience, 100))
         .otherwise(trim_words(cleaned, 90))),
        ("Projects / Education",
         trim_words(first_section(section_map, V.PROJECT_HEADINGS), 80)),
    ]
    return F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(k).alias("title"), v.alias("body")) for k, v in entries]),
        lambda e: e["body"] != ""))


# --- candidate × posting ------------------------------------------------------------------------

def pair_keywords(skills: Column, named: Column, limit: int = 10) -> Column:
    """Supported skills that the posting names (lower case), else the first supported skills."""
    found = F.slice(F.filter(skills, lambda s: F.array_contains(named, F.lower(s))), 1, limit)
    return F.when(F.size(found) > 0, found).otherwise(F.slice(skills, 1, limit))


def infra_context(*texts: Column) -> Column:
    """Whether the texts, joined by blanks, speak of a machine-learning platform."""
    return contains_any(F.lower(F.concat_ws(" ", *texts)), V.INFRA_CONTEXT_TERMS)


#: No context term is longer, so a term across two texts lies in so much of their ends.
CONTEXT_EDGE = max(map(len, V.INFRA_CONTEXT_TERMS))


def edges(text: Column) -> Column:
    """Start and end of a text, or all of a short one: what a term across texts can touch."""
    return F.when(F.length(text) <= 2 * CONTEXT_EDGE, text).otherwise(F.concat(
        F.substring(text, 1, CONTEXT_EDGE), F.lit("\n"), F.right(text, F.lit(CONTEXT_EDGE))))


def infra_skills(skills: Column) -> Column:
    return F.filter(skills, lambda s: F.lower(s).isin(list(V.INFRA_SKILLS)))
