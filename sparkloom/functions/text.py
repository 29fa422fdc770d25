"""Text functions as Spark expressions. Null text behaves as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RS = "\x1e"


def or_empty(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def present(c: Column) -> Column:
    """Null for missing values in either form: null or blank."""
    return F.nullif(F.trim(c), F.lit(""))


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row. An expression that a lambda refers to would be computed anew for every element."""
    return F.transform(F.array(value), use)[0]


def tokens(c: Column) -> Column:
    """Lower case, then runs of Unicode word characters."""
    return F.regexp_extract_all(F.lower(or_empty(c)), F.lit(r"(?U)\w+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(or_empty(c), r"\s+"), lambda x: x != ""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(or_empty(c), r"\s+", " "))


def normalised(c: Column) -> Column:
    return F.lower(squeeze(c))


def sentences(c: Column) -> Column:
    """Split after . ! ? at white space; blank parts go."""
    return F.filter(F.split(or_empty(c), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def claims(c: Column) -> Column:
    """As sentences, but only where a capital or an opening quote follows; trimmed."""
    parts = F.transform(F.split(or_empty(c), "(?<=[.!?])\\s+(?=[A-Z\"'“])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def head(c: Column, n: int) -> Column:
    return F.substring(or_empty(c), 1, n)


def snippet(c: Column, most: int) -> Column:
    """White space collapsed; if longer than ``most``, cut there, back to the last space, and an ellipsis added."""
    flat = squeeze(c)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, most), r" [^ ]*$", ""), F.lit("…")))


def slug(c: Column, most: int = 50) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(or_empty(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def markdown_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_{}\[\]<>|$])", r"\\$1")


# Cue words per language, and those of them that the other language lacks.
ES_WORDS = ["de", "la", "el", "en", "los", "las", "del", "por", "para", "con", "una"]
FR_WORDS = ["de", "la", "le", "les", "des", "du", "en", "et", "pour", "dans", "une"]
ES_ONLY = ["los", "las", "para", "pero", "como"]
FR_ONLY = ["les", "des", "dans", "cette", "sont"]


def texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def language(c: Column) -> Column:
    """Script first (ar, zh, ru on 500 characters), then cue words on 2,000: more than four cues and one of the language's own; else en."""
    start = head(c, 500)
    ws = F.split(F.lower(head(c, 2000)), r"\s+")

    def cued(cues, own):
        return (F.size(F.array_intersect(ws, texts(cues))) > 4) & F.arrays_overlap(ws, texts(own))

    return (
        F.when(start.rlike("[؀-ۿ]"), "ar")
        .when(start.rlike("[一-鿿]"), "zh")
        .when(start.rlike("[Ѐ-ӿ]"), "ru")
        .when(cued(ES_WORDS, ES_ONLY), "es")
        .when(cued(FR_WORDS, FR_ONLY), "fr")
        .otherwise("en")
    )


def date_of(c: Column) -> Column:
    """ISO date or date-time, else day month year, month year, year; as yyyy-MM-dd, '' if none reads."""
    v = F.trim(or_empty(c))
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(F.substring(v, 1, 10), F.lit("yyyy-MM-dd")))
    forms = [F.when(v.rlike(shape), F.try_to_timestamp(v, F.lit(form))) for shape, form in ((r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"), (r"^[A-Za-z]+ \d{4}$", "MMMM yyyy"), (r"^\d{4}$", "yyyy"))]
    return F.coalesce(F.date_format(F.coalesce(iso, *forms), "yyyy-MM-dd"), F.lit(""))


def is_prose(c: Column, least: int = 3) -> Column:
    return F.regexp_count(or_empty(c), F.lit(r"[a-z]\.\s+[A-Z]")) >= least


# Headings and credit labels of pages without content.
HEADINGS = r"\b(acknowledge?ments?|references|bibliography|appendix|annex(es)?|table of contents|list of (figures|tables|abbreviations|acronyms)|contributors|about the authors?|abbreviations and acronyms|worksheet|checklist|self.?assessment|application form|template)\b"
CREDITS = r"\b(coordinators?|authors?|reviewers?|editors?|contributors?|produced (with|by)|published (in|by)|copyright|all rights reserved|under the supervision of|supported by|funded by)\s*[:\-]"
YEAR_PAREN = r"\b(?:19|20)\d{2}\)"


def is_content(c: Column, density: float = 0.012, years: int = 5) -> Column:
    """False for a page with a listed heading near its start, no words, too many credit labels a word, or too many years in brackets."""
    t, n = or_empty(c), word_count(c)
    dense = F.regexp_count(t, F.lit("(?i)" + CREDITS)) / F.greatest(n, F.lit(1)) > density
    return ~(head(c, 300).rlike("(?i)" + HEADINGS) | (n == 0) | dense | (F.regexp_count(t, F.lit(YEAR_PAREN)) > years))


# What counts as a year, and as a range of years.
YEAR = r"\b(19[89]\d|20[0-4]\d)\b"
YEARS = r"\b(19[89]\d|20[0-4]\d)\s*[-–—]\s*(19[89]\d|20[0-4]\d)\b"


def temporal_coverage(c: Column) -> Column:
    """Least and greatest year of explicit ranges; without ranges of all years; one year alone; '' without any."""
    t = head(c, 15_000)
    ends = F.concat(F.regexp_extract_all(t, F.lit(YEARS), F.lit(1)), F.regexp_extract_all(t, F.lit(YEARS), F.lit(2)))
    single = F.regexp_extract_all(t, F.lit(YEAR), F.lit(0))
    both = lambda a: F.concat_ws("-", F.array_min(a), F.array_max(a))
    return F.when(F.size(ends) > 0, both(ends)).when(F.size(single) > 1, both(single)).otherwise(F.coalesce(F.get(single, F.lit(0)), F.lit("")))


# What names a framework.
FRAMEWORKS = {
    "sendai_framework": r"sendai\s+framework|sfdrr",
    "hyogo_framework": r"hyogo\s+framework|hfa\b",
    "paris_agreement": r"paris\s+agreement|paris\s+accord",
    "sdgs": r"sustainable\s+development\s+goals?|\bsdgs?\b",
    "new_urban_agenda": r"new\s+urban\s+agenda",
    "addis_ababa_action_agenda": r"addis\s+ababa\s+action\s+agenda|\baaaa\b",
    "samoa_pathway": r"samoa\s+pathway|s\.?a\.?m\.?o\.?a\.?\s+pathway|small\s+island\s+developing\s+states\s+accelerated\s+modalities",
    "istanbul_programme_of_action": r"istanbul\s+programme\s+of\s+action|\bipoa\b",
}


def tagged(c: Column, patterns: dict[str, str], most: int = 30_000) -> Column:
    """The ids whose pattern is found, in the order given."""
    t = head(c, most)
    return F.filter(F.array(*[F.when(t.rlike("(?i)" + p), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())


def mentioned(c: Column, names: Column, most: int = 20_000) -> Column:
    """The names, in their own order, that stand in the text as whole words, in any case."""
    spaced = lambda x: F.concat(F.lit(" "), F.array_join(tokens(x), " "), F.lit(" "))
    return let(spaced(head(c, most)), lambda t: F.filter(names, lambda n: F.contains(t, spaced(n))))


def labelled_list(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(label + ": "), F.array_join(values, ", ")))


# Boilerplate that refers to the source of a question.
_REF = r"(?:the|this)(?:\s+\w+){0,4}?\s+(?:passage|document|text|chunk|excerpt|report)"
BOILERPLATE = (
    rf"\baccording to {_REF}[,\s]*",
    rf"\bin {_REF}[,\s]*",
    rf"\bas (?:mentioned|described|stated|noted|indicated) in {_REF}[,\s]*",
    rf"\b{_REF}\s+(?:says|states|mentions|notes|describes|reports|indicates)\s+(?:that\s+)?",
)


def clean_question(c: Column) -> Column:
    for p in BOILERPLATE:
        c = F.regexp_replace(c, "(?i)" + p, "")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"\s+([?.!,;:])", "$1")
    c = F.regexp_replace(c, "^[ ,;:]+|[ ,;:]+$", "")
    c = F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))
    return F.when(c == "", "").when(c.endswith("?"), c).otherwise(F.concat(c, F.lit("?")))


# What a list's lines begin with, in the order in which it is taken off, and what ends a line's number, in order of precedence.
BULLETS = ["* ", "- ", "• ", "→ "]
NUMBER_ENDS = [". ", ") ", " - ", ": "]


def _bare(line: Column) -> Column:
    """A line without its bullets (each kind once) and its number, if that ends within five characters."""
    line = F.trim(line)
    for b in BULLETS:
        line = F.when(line.startswith(b), F.trim(F.substring(line, len(b) + 1, 1 << 30))).otherwise(line)
    start, text = F.substring(line, 1, 5), line
    for end in reversed(NUMBER_ENDS):
        text = F.when(start.contains(end), F.trim(F.substr(line, F.instr(line, end) + len(end)))).otherwise(text)
    return F.when((F.length(line) > 2) & line.rlike(r"^\d"), text).otherwise(line)


def parse_questions(c: Column, most: int) -> Column:
    """Questions from free text, a line each: bullets and numbers go, the text ends at its first question mark, is cleaned, kept at 10 to
    300 characters, once, the first ``most``."""
    lines = F.filter(F.transform(F.split(or_empty(c), r"\r\n|\n|\r"), _bare), lambda x: x.contains("?"))
    qs = F.transform(lines, lambda x: clean_question(F.concat(F.trim(F.substring_index(x, "?", 1)), F.lit("?"))))
    return F.slice(F.array_distinct(F.filter(qs, lambda q: (F.length(q) >= 10) & (F.length(q) <= 300))), 1, most)


def parse_paraphrase(c: Column, original: Column) -> Column:
    """The first line with a question mark, else the first line; a bullet, a number, a label and quotes go; cut at the mark and cleaned;
    the original where nothing is left."""
    lines = F.filter(F.transform(F.split(or_empty(c), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    line = F.coalesce(F.get(F.filter(lines, lambda x: x.contains("?")), F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))
    line = F.regexp_replace(F.regexp_replace(line, r"^(\* |- |• |→ )\s*", ""), r"^\d+[.)]\s*", "")
    line = F.regexp_replace(line, r"(?i)^\s*(?:rewritten|rephrased|paraphrased|reworded|new)?\s*question\s*[:\-]\s*", "")
    line = F.trim(F.regexp_replace(F.trim(line), "^[\"']+|[\"']+$", ""))
    cut = F.when(line.contains("?"), F.concat(F.trim(F.substring_index(line, "?", 1)), F.lit("?"))).otherwise(line)
    return F.coalesce(F.nullif(clean_question(cut), F.lit("")), original)


# What a refusal says.
REFUSALS = ["cannot answer", "can't answer", "cannot be answered", "not in the", "no information", "unable to answer", "does not provide", "doesn't provide", "not provided in"]
SOFT_REFUSALS = ["cannot be determined", "not specified", "i cannot", "not mentioned", "insufficient information", "not addressed"]


def says_any(c: Column, phrases: list[str]) -> Column:
    return let(F.lower(or_empty(c)), lambda t: F.exists(texts(phrases), lambda p: F.contains(t, p)))


def cti_bucket(c: Column) -> Column:
    return F.when(c >= 0.30, "context").when(c <= 0.05, "parametric").otherwise("mixed")


def support_bucket(c: Column) -> Column:
    return F.when(c >= 0.65, "strong").when(c >= 0.45, "partial").otherwise("none")


def citation_tags(c: Column) -> Column:
    """The numbers of [P1], [P2], ... in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(or_empty(c), F.lit(r"\[P(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def shingles(ws: Column, n: int) -> Column:
    def make(w):
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(ws, make)


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based (SHA-1) UUID, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
