"""Text primitives: cleaning, normal forms and dictionary-term matching.

Terms are found by words: a normalised text is split once, the words that are keys of
terms are looked up, and only the terms of these keys are searched for.  Other texts are
read once with a prefix tree of all terms, written as a single regular expression that
reports, at every word start, the longest term that ends on a word boundary; shorter
terms that end inside a reported term are known when the plan is built.  Everything after
that works on the short array of hits instead of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes below are written as plain ranges.  Negated or Unicode-flagged classes
# match the same texts but make all tasks of one JVM wait for each other (a type-check
# cache of the regex engine is shared), which cost a factor of seven on eight cores.
# fixed value: the white space of Unicode text
BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITESPACE = f"[{BLANKS}]+"
#: The same characters, one by one.
BLANK_CHARS = "".join(chr(i) for i in (
    *range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028,
    0x2029, 0x202f, 0x205f, 0x3000))


def _one_by_one(codes: Iterable[int]) -> str:
    """Characters below 256 for a class, where the regex engine looks them up in one bit set."""
    return "".join(rf"\x{i:02x}" for i in codes)


def _runs(chars: str) -> str:
    """Runs of a class with the blank, but for single blanks: replacing these changes nothing."""
    return f"[{chars}](?:(?<! )|[{chars}])[{chars}]*"


# other characters are tried behind one range
_BLANK_RUNS = _runs(_one_by_one(ord(c) for c in BLANK_CHARS if ord(c) < 256) + (
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"))
#: What a search form keeps of lower-cased text.
SEARCH_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789+#."
SEARCH_GAPS = _runs(_one_by_one(i for i in range(128) if chr(i) not in SEARCH_CHARS) + r"\x{80}-\x{10FFFF}")
# word edges, written out so that every JVM version reads them alike
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"
# everything but a-z, 0-9 and the kept signs, for lower-cased text
LOCATION_GAPS = r"\P{Alnum}+"
# a single blank between kept characters stays as it is
COVERAGE_GAPS = r'(?! [a-z0-9+#.-])[\x00-"$-*,/:-`{-\x{10FFFF}]+'
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
BOUND_LEFT = r"(?<!\p{Alnum})"
BOUND_RIGHT = r"(?!\p{Alnum})"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_ws(c: Column) -> Column:
    """NULL becomes ''; every run of white space becomes one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(c), _BLANK_RUNS, " "))


def strip(c: Column) -> Column:
    """Remove white space at both ends only."""
    return F.btrim(c.cast("string"), F.lit(BLANK_CHARS))


def sql_string(value: str) -> str:
    """SQL literal of a text; long constant lists are parsed in one call."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def string_array(values: Iterable[str]) -> Column:
    values = list(values)
    if not values:
        return F.expr("cast(array() as array<string>)")
    return F.expr("array(" + ", ".join(map(sql_string, values)) + ")")


# --- normal forms ---------------------------------------------------------------

def location_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), LOCATION_GAPS, " "))


def search_form(c: Column) -> Column:
    """Lower case, only ``a-z0-9+#.``, single blanks, no padding."""
    return F.trim(F.regexp_replace(F.lower(c), SEARCH_GAPS, " "))


def coverage_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), COVERAGE_GAPS, " "))


def pad(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def pad_or_blank(c: Column) -> Column:
    """The coverage report pads like ``pad`` but keeps a single blank for ''."""
    return F.when(c == "", F.lit(" ")).otherwise(pad(c))


def join_forms(*parts: Column) -> Column:
    """Normal form of texts joined by a blank, from the parts' normal forms."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def norm_location(c: Column) -> Column:
    return location_form(c)


def norm_search(c: Column) -> Column:
    return pad(search_form(c))


def norm_coverage(c: Column) -> Column:
    return pad_or_blank(coverage_form(c))


def search_term(term: str) -> str:
    return re.sub(r"[^a-z0-9+#.]+", " ", term.lower()).strip()


def coverage_term(term: str) -> str:
    return re.sub(r"[^a-z0-9+#.-]+", " ", term.lower()).strip()


def plain_term(term: str) -> str:
    return term.lower()


def contains_phrase(text: Column, phrase: Column | str) -> Column:
    """Substring test on normal forms, without word boundaries."""
    if isinstance(phrase, str):
        return norm_search(text).contains(search_term(phrase))
    return F.contains(norm_search(text), search_form(phrase))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """Does the text contain one of the needles anywhere?  One pass over the text."""
    return text.rlike(_tree_pattern(sorted(set(needles))))


def contains_one(text: Column, needles: Iterable[str]) -> Column:
    """``contains_any`` for a column and few needles, one search each."""
    found = F.lit(False)
    for needle in sorted(set(needles)):
        found = found | text.contains(needle)
    return found


# --- dictionary terms -------------------------------------------------------------

def quote(term: str) -> str:
    return re.sub(r"([.+#*?()\[\]{}|^$\\/-])", r"\\\1", term)


#: So many characters side by side; the engine tries them one by one.
BRANCHES = 4


def _tree_pattern(terms: Sequence[str]) -> str:
    """One alternation per branching character, longest continuation first."""
    ends_here = "" in terms
    branches: dict[str, list[str]] = {}
    for term in terms:
        if term:
            branches.setdefault(term[0], []).append(term[1:])
    if not branches:
        return ""
    heads = sorted(branches)
    options = [quote(head) + _tree_pattern(branches[head]) for head in heads]
    if len(options) > 2 * BRANCHES:
        # a few classes of first characters are tried before the characters themselves
        options = [f"(?=[{''.join(map(quote, heads[i:i + BRANCHES]))}])"
                   f"(?:{'|'.join(options[i:i + BRANCHES])})" for i in range(0, len(heads), BRANCHES)]
    if len(options) == 1 and not ends_here:
        return options[0]
    return "(?:" + "|".join(options) + ")" + ("?" if ends_here else "")


def apart(normal_text: Column, signs: str = "+#.") -> Column:
    """``normal_text`` with blanks around every sign that its form keeps."""
    for sign in signs:
        normal_text = F.replace(normal_text, F.lit(sign), F.lit(f" {sign} "))
    return normal_text


def apart_term(term: str) -> str:
    return re.sub(r"([+#.-])", r" \1 ", term)


class TermIndex:
    """Finds which of a fixed set of terms occur in a normalised text."""

    def __init__(self, *dictionaries: Iterable[str],
                 form: Callable[[str], str] = search_term):
        self.form = form
        self.terms = sorted({form(t) for d in dictionaries for t in d})
        #: Terms by their longest word, which a text with the term has.
        self.by_word: dict[str, list[str]] = {}
        for term in self.terms:
            self.by_word.setdefault(max(apart_term(term).split() or [""], key=len), []).append(term)
        tree = _tree_pattern(self.terms)
        self.pattern = f"{BOUND_LEFT}(?=({tree}){BOUND_RIGHT})"
        self.implied: dict[str, list[str]] = {}
        for term in self.terms:
            shorter = [s for s in self.terms
                       if s != term and term.startswith(s)
                       and not re.match("[a-z0-9]", term[len(s)])]
            if shorter:
                self.implied[term] = shorter

    def hits(self, normal_text: Column) -> Column:
        """Distinct terms present in ``normal_text`` as array<string>."""
        if self.form not in (search_term, coverage_term):
            return self._hits_of_any(normal_text)
        signs = "+#." if self.form is search_term else "+#.-"
        return self.hits_apart(pad(apart(normal_text, signs)))

    def hits_apart(self, text: Column) -> Column:
        """``hits`` of a padded text whose signs are ``apart``.

        A term ends where no letter or digit follows, so it stands between blanks here.
        """
        rows = "map(" + ", ".join(f"{sql_string(word)}, array(" + ", ".join(
            f"named_struct('term', {sql_string(t)}, 'form', {sql_string(self._searched(t, word))})"
            for t in terms) + ")" for word, terms in self.by_word.items()) + ")"

        def confirmed(text: Column) -> Column:
            keys = F.array_intersect(string_array(self.by_word), F.split(text, " "))
            tried = F.flatten(F.transform(keys, lambda k: F.try_element_at(F.expr(rows), k)))
            return F.transform(F.filter(tried, lambda t: F.contains(text, t["form"])),
                               lambda t: t["term"])

        return let(text, confirmed)

    @staticmethod
    def _searched(term: str, word: str) -> str:
        """What a text with ``word`` must contain; nothing more for a term of one word."""
        return "" if term == word else f" {apart_term(term)} "

    def hits_among(self, text: Column, terms: Column) -> Column:
        """``hits_apart``, given ``terms`` that include all terms of this text; NULL of NULL."""
        own = F.array_intersect(string_array(self.terms), terms)
        return let(text, lambda text: F.when(text.isNotNull(), F.filter(
            own, lambda t: F.contains(text, pad(apart(t))))))

    def _hits_of_any(self, text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(self.pattern), 1))
        if not self.implied:
            return found
        shorter = F.expr("map(" + ", ".join(
            f"{sql_string(term)}, array({', '.join(map(sql_string, inner))})"
            for term, inner in self.implied.items()) + ")")
        extra = F.flatten(F.transform(
            F.filter(found, lambda t: t.isin(list(self.implied))),
            lambda t: F.try_element_at(shorter, t)))
        return F.array_union(found, extra)


def dictionary_sql(terms: Iterable[str], form: Callable[[str], str] = search_term) -> str:
    """SQL array of (term, normal form) structs, in the order given."""
    rows = ", ".join(f"named_struct('term', {sql_string(t)}, 'form', {sql_string(form(t))})"
                     for t in terms)
    return f"array({rows})" if rows \
        else "cast(array() as array<struct<term:string,form:string>>)"


def matched_from(hits: Column, dictionary: Column) -> Column:
    """Terms of ``dictionary`` whose normal form is among ``hits``."""
    return F.transform(F.filter(dictionary, lambda d: F.array_contains(hits, d["form"])),
                       lambda d: d["term"])


def matched_terms(hits: Column, terms: Iterable[str],
                  form: Callable[[str], str] = search_term) -> Column:
    """Sorted list of the dictionary terms present, given the text's hits."""
    terms = sorted(terms)
    if all(form(t) == t for t in terms):
        # keeps the order of the first array
        return F.array_intersect(string_array(terms), hits)
    return matched_from(hits, F.expr(dictionary_sql(terms, form)))


def any_term(hits: Column, terms: Iterable[str],
             form: Callable[[str], str] = search_term) -> Column:
    return F.arrays_overlap(hits, string_array(sorted({form(t) for t in terms})))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas of ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def find_terms(text: Column, terms: Iterable[str]) -> Column:
    """Stand-alone form: sorted dictionary terms bounded in ``text``."""
    terms = list(terms)
    return let(TermIndex(terms).hits(norm_search(text)), lambda hits: matched_terms(hits, terms))


def any_pattern(terms: Iterable[str], form: Callable[[str], str] = search_term) -> str:
    """One bounded alternation for a whole dictionary, for ``rlike``."""
    return BOUND_LEFT + "(?:" + _tree_pattern(sorted({form(t) for t in terms})) + ")" + BOUND_RIGHT


def match_any(normal_text: Column, terms: Iterable[str],
              form: Callable[[str], str] = search_term) -> Column:
    return normal_text.rlike(any_pattern(terms, form))


# --- lists typed by users ------------------------------------------------------------

def _split_list(c: Column, separators: str) -> Column:
    parts = F.transform(F.split(F.lower(text_or_empty(c)), separators), strip)
    return F.filter(parts, lambda p: p != "")


def split_keywords(c: Column) -> Column:
    return _split_list(c, "[,;\n]+")


def split_target_roles(c: Column) -> Column:
    return _split_list(c, "[,;/\n]+")


def combine_skills(manual: Column, extracted: Column) -> Column:
    """Ordered union of typed and extracted skills; the first spelling is kept."""
    both = F.concat(split_keywords(manual), extracted)
    keys = F.transform(both, F.lower)
    return F.transform(
        F.filter(F.arrays_zip(both.alias("skill"), F.transform(
            both, lambda s, i: F.array_position(keys, F.lower(s)) == i + 1).alias("first")),
            lambda z: z["first"]),
        lambda z: z["skill"])


def comma_values(c: Column, ignored: Sequence[str]) -> Column:
    parts = F.transform(F.split(text_or_empty(c), ","), lambda p: F.lower(strip(p)))
    return F.filter(parts, lambda p: (p != "") & ~p.isin(list(ignored)))


def title_terms(c: Column, dropped: Sequence[str], limit: int = 8) -> Column:
    words = F.regexp_extract_all(F.lower(text_or_empty(c)),
                                 F.lit("([a-z][a-z+#.]{2,})"), 1)
    return F.slice(F.filter(words, lambda w: ~w.isin(list(dropped))), 1, limit)


def title_case(c: Column) -> Column:
    """Capitalise each run of letters, also after digits and punctuation."""
    runs = F.regexp_extract_all(c, F.lit(r"(?U)(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def skill_name(c: Column, names: dict[str, str]) -> Column:
    normal = F.lower(clean_ws(c))
    table = F.expr("map(" + ", ".join(f"{sql_string(k)}, {sql_string(v)}"
                                      for k, v in names.items()) + ")")
    return F.coalesce(F.try_element_at(table, normal), title_case(normal))


def skill_display(c: Column, names: dict[str, str], noise: Sequence[str]) -> Column:
    """Readable, de-duplicated list of profile skills."""
    def tidy(raw: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(raw, "[^a-zA-Z0-9+#/ -]+", " ")), " +")
        kept = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(list(noise)))
        return F.regexp_replace(F.array_join(kept, " "), "^[ -]+|[ -]+$", "")

    parts = F.transform(F.split(text_or_empty(c), "[,;\n.]+"), tidy)
    parts = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(list(noise)))
    # names depend on the lower-cased skill only, so distinct keys give distinct skills
    keys = F.array_distinct(F.transform(parts, F.lower))
    return F.array_join(F.transform(keys, lambda k: skill_name(k, names)), ", ")


def extract_skills(text: Column, vocabulary: Sequence[str]) -> Column:
    """Vocabulary skills present in ``text``, in vocabulary order."""
    lowered = F.lower(F.regexp_replace(text_or_empty(text), WHITESPACE, " "))
    return let(TermIndex(vocabulary, form=plain_term).hits(lowered), lambda hits: matched_from(
        hits, F.expr(dictionary_sql(vocabulary, plain_term))))


def safe_number(c: Column) -> Column:
    """Number or NULL; '', 'unknown' and anything unreadable are NULL."""
    t = strip(c.cast("string"))
    readable = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(readable, t.try_cast("double"))
