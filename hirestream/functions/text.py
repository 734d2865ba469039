"""String and regex column functions.

All of these are built-in Spark expressions (JVM-side, codegen'd). Patterns are
written so that Java regex and RE2 agree on them (ASCII classes, no
look-around), which keeps the DuckDB oracle comparable.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the published behaviour) -----------------------
# Résumé section aliases: canonical section -> accepted heading texts.
SECTION_ALIASES = {
    "summary": ["summary", "professional summary", "profile", "objective", "about"],
    "experience": ["experience", "work experience", "professional experience", "employment",
                   "career history"],
    "skills": ["skills", "technical skills", "core competencies", "key skills"],
    "education": ["education", "academic background", "qualifications"],
    "certifications": ["certifications", "certificates", "licenses"],
    "projects": ["projects", "key projects", "select projects"],
    "publications": ["publications", "papers", "research"],
    "languages": ["languages"],
    "awards": ["awards", "honors", "achievements", "accomplishments"],
}
# Headings the renderer writes; three of them must appear for the heading check.
SECTION_HEADINGS = {"summary": "Professional Summary", "experience": "Work Experience", "skills": "Skills",
                    "projects": "Projects", "education": "Education", "certifications": "Certifications",
                    "publications": "Publications", "languages": "Languages", "awards": "Awards & Achievements"}
STANDARD_HEADINGS = list(SECTION_HEADINGS.values())
SECTION_ORDER = list(SECTION_HEADINGS)
# Phrases never kept as keywords.
STOP_PHRASES = ["good to have", "must have", "team player", "self motivated", "fast paced",
                "results driven", "go getter", "minimum qualifications",
                "preferred qualifications", "key responsibilities", "job description",
                "about the role", "what you ll do", "what you will do",
                "responsibilities include"]
EMAIL_PATTERN = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"
PHONE_PATTERN = r"(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,5}\)?[\s.-]?)?\d{3,5}[\s.-]?\d{3,5}"
LOOSE_PHONE_PATTERN = r"\d[\d\s().+-]{6,}\d"
LINKEDIN_PATTERN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9_-]+"
GITHUB_PATTERN = r"(?i)(?:https?://)?(?:www\.)?github\.com/[A-Za-z0-9_-]+"
URL_PATTERN = r"(?i)https?://[^\s]+"
TOKEN_PATTERN = r"[a-z0-9][a-z0-9\-\+/#\.]{1,40}"
DATE_PATTERN = r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s*\d{4}|\d{1,2}/\d{4}|\d{4})"
DATE_RANGE_PATTERN = (r"(?i)(" + DATE_PATTERN + r")\s*[-–to]+\s*(" + DATE_PATTERN
                      + r"|Present|Current)")
BULLET_MARKS = "-*•·◦"
ROLE_EDGES = " -–|,"
BLANKS = " \t\n\x0b\f\r"
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# -----------------------------------------------------------------------------


def _ne(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def flatten_ws(c: Column) -> Column:
    """Squeeze runs of whitespace, trim."""
    return F.trim(F.regexp_replace(_ne(c), r"\s+", " "))


def clean_posting_text(c: Column) -> Column:
    """Drop URLs and e-mail-like tokens, keep ``A-Za-z0-9 -/+.#``, squeeze."""
    t = F.regexp_replace(_ne(c), r"https?://\S+", " ")
    t = F.regexp_replace(t, r"\S+@\S+", " ")
    t = F.regexp_replace(t, r"[^A-Za-z0-9 \-/\+\.#]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def resume_tokens(c: Column) -> Column:
    """R2: distinct lower-case tokens of a text blob."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_ne(c)), F.lit(TOKEN_PATTERN), 0))


def normalise_text(c: Column) -> Column:
    """Lower case with whitespace runs squeezed (not trimmed)."""
    return F.regexp_replace(F.lower(_ne(c)), r"\s+", " ")


def contains_term(hay: Column, needle: Column) -> Column:
    """Blank needle never matches; otherwise plain lower-case containment."""
    n = F.lower(_ne(needle))
    return (n != "") & F.contains(hay, n)


def naive_canonical(phrase: Column) -> Column:
    """Per-word suffix strip (``ing`` for words over 4 chars, else ``ies``/``es``/``s``
    for words over 3 chars when at least 2 chars remain), then collapse adjacent
    duplicate words."""
    words = F.regexp_replace(F.regexp_replace(F.lower(_ne(phrase)), r"^\s+|\s+$", ""), r"\s+", " ")
    # a word is a run between spaces; the stem keeps the least that the rule asks for
    stripped = F.regexp_replace(words, r"(?<=^| )(?:([^ ]{2,})ing|([^ ]{2,}?)(?:ies|es)|([^ ]{3,})s)(?= |$)", "$1$2$3")
    return F.regexp_replace(stripped, r"(?<=^| )([^ ]+)(?: \1)+(?= |$)", "$1")


_STEM = re.compile("([^ ]{2,})ing|([^ ]{2,}?)(?:ies|es)|([^ ]{3,})s")
_BLANKS = re.compile(r"\s+", re.ASCII)


def stem_word(word: str) -> str:
    """R3's suffix strip of one word without blanks."""
    if word[-1:] not in ("g", "s"):  # what has none of the suffixes needs no pattern
        return word
    m = _STEM.fullmatch(word)
    return m[m.lastindex] if m else word


def naive_canonical_text(phrase: str, stems: dict[str, str]) -> str:
    """R3 of one text, as :func:`naive_canonical` (which see), inside a task. ``stems`` keeps
    the words met (lower case, no blanks), so that each is stripped once and most phrases are
    put together from two of them; the caller bounds it."""
    a, _, b = phrase.partition(" ")
    x, y = stems.get(a), stems.get(b)
    if x and (y or phrase == a):
        return x if phrase == a or x == y else x + " " + y
    out = []
    for w in _BLANKS.sub(" ", phrase.lower()).strip(" ").split(" "):
        s = stems.get(w)
        if s is None:
            s = stems[w] = stem_word(w)
        if not out or out[-1] != s:
            out.append(s)
    return " ".join(out)


def pytrim(c: Column) -> Column:
    """Strip leading and trailing whitespace of any kind (``trim`` only drops spaces)."""
    return F.regexp_replace(_ne(c), r"^\s+|\s+$", "")


def _or_pattern(t: Column, native: Column, pattern: Column) -> Column:
    """``native``, or ``pattern`` where a last character is one that ``$`` may stand before."""
    return F.when(F.substring(t, -1, 1).isin("\n", "\r", "\u0085", "\u2028", "\u2029"), pattern).otherwise(native)


def trim_blanks(c: Column) -> Column:
    """:func:`pytrim` without a pattern, for a column as it stands (it is named three times)."""
    return _or_pattern(_ne(c), F.btrim(_ne(c), F.lit(BLANKS)), pytrim(c))


def trim_chars(c: Column, chars: str) -> Column:
    """:func:`strip_chars` without a pattern, for a column as it stands."""
    return _or_pattern(c, F.btrim(c, F.lit(chars)), strip_chars(c, chars))


def split_lines(c: Column) -> Column:
    """Lines with trailing whitespace removed (CRLF, CR and LF all break)."""
    cut = F.when(F.contains(_ne(c), F.lit("\r")), F.split(_ne(c), r"\r\n|\r|\n")).otherwise(F.split(_ne(c), "\n"))
    return F.transform(cut,
                       lambda x: _or_pattern(x, F.rtrim(x, F.lit(BLANKS)), F.regexp_replace(x, r"\s+$", "")))


def head_text(lines: Column, n: int) -> Column:
    return F.array_join(F.slice(lines, 1, n), "\n")


def _digit_count_ok(m: Column) -> Column:
    digits = F.length(F.regexp_replace(m, r"[^0-9]", ""))
    return (digits >= 7) & (digits <= 15)


def contacts(text: Column, head_lines: int = 20, lines: Column | None = None) -> Column:
    """E-mail and phone from the first lines, profile links from the whole text.
    ``lines`` are those of the text, if the caller has them."""
    head = head_text(split_lines(text) if lines is None else lines, head_lines)
    email = F.regexp_extract(head, EMAIL_PATTERN, 0)
    phone_m = F.regexp_extract(head, PHONE_PATTERN, 0)
    phone = F.when(_digit_count_ok(phone_m), F.trim(phone_m)).otherwise(F.lit(""))

    def link(pattern: str) -> Column:  # a text without a slash has no link, and needs no pattern
        return F.when(F.contains(_ne(text), F.lit("/")), F.regexp_extract(_ne(text), pattern, 0)).otherwise(F.lit(""))
    return F.struct(
        email.alias("email"),
        phone.alias("phone"),
        link(LINKEDIN_PATTERN).alias("linkedin"),
        link(GITHUB_PATTERN).alias("github"),
    )


def name_guess(lines: Column) -> Column:
    """First of the first 10 lines with 2-6 words, at most one not capitalised,
    and no e-mail, URL or phone."""
    def ok(x: Column) -> Column:  # what costs least comes first
        s, words = x.getField("s"), x.getField("words")
        caps = F.size(F.filter(words, lambda w: (F.upper(F.substring(w, 1, 1)) == F.substring(w, 1, 1))
                               & (F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1))))
        return ((F.size(words) > 1) & (F.size(words) <= 6) & (caps >= F.size(words) - 1)
                & ~s.rlike(EMAIL_PATTERN) & ~s.rlike(URL_PATTERN) & ~s.rlike(PHONE_PATTERN))

    trimmed = F.transform(F.slice(lines, 1, 10), lambda x: trim_blanks(x))
    cands = F.filter(F.transform(trimmed, lambda s: F.struct(
        s.alias("s"), F.filter(F.split(s, r"\s+"), lambda w: w != "").alias("words"))), ok)
    return F.try_element_at(cands, F.lit(1)).getField("s")


def section_alias_map() -> Column:
    pairs = [(a, canon) for canon, aliases in SECTION_ALIASES.items() for a in aliases]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def detect_section(line: Column) -> Column:
    """Canonical section of a heading line, else NULL."""
    # a heading is an alias, so what a pattern's "$" does before odd line ends is all the same;
    # lower case costs most and is left for what can be one
    cleaned = F.rtrim(F.btrim(_ne(line), F.lit(BLANKS)), F.lit(":"))
    longest = max(len(a) for aliases in SECTION_ALIASES.values() for a in aliases)
    return F.when((F.length(cleaned) <= longest) & ~F.substring(cleaned, 1, 1).isin("", *BULLET_MARKS),
                  F.try_element_at(section_alias_map(), F.lower(cleaned)))


def strip_chars(c: Column, chars: str) -> Column:
    """Python-style ``str.strip(chars)`` for a fixed character set."""
    cls = "[" + "".join("\\" + ch if ch in "-]\\^[" else ch for ch in chars) + "]+"
    return F.regexp_replace(F.regexp_replace(c, "^" + cls, ""), cls + "$", "")


def split_skills(c: Column) -> Column:
    """Split on , ; | • · or 2+ blanks; keep parts of 2..59 chars; distinct, sorted."""
    parts = F.split(_ne(c), r"[,;|•·]| {2,}")
    kept = F.filter(parts, lambda p: (F.length(F.trim(p)) > 1) & (F.length(F.trim(p)) < 60))
    return F.sort_array(F.array_distinct(F.transform(kept, lambda p: trim_chars(p, " -·•"))))


def is_bullet(line: Column) -> Column:
    """R11."""
    return pytrim(line).rlike("^[" + BULLET_MARKS.replace("-", "\\-") + "]")


def strip_bullet(line: Column) -> Column:
    return pytrim(strip_chars(pytrim(line), " " + BULLET_MARKS))


def date_range(line: Column) -> Column:
    """T-5: ``struct<has_range,start,end,prefix>``; prefix is the text before the range.

    The groups are taken from the whole match, which the pattern matches in the same way;
    the prefix is cut at its position, which is its first occurrence because the match is
    leftmost. A line without four digits in a row has no date and is not matched at all."""
    return date_parts(line, date_match(line))


def date_match(line: Column) -> Column:
    """What :func:`date_range` matches of a line, or an empty text."""
    s = _ne(line)
    return F.when(s.rlike("[0-9]{4}"), F.regexp_extract(s, DATE_RANGE_PATTERN, 0)).otherwise(F.lit(""))


def date_parts(line: Column, whole: Column) -> Column:
    """:func:`date_range` of a line and its :func:`date_match`."""
    has = whole != ""
    prefix = F.when(has, F.substring(_ne(line), F.lit(1), F.position(whole, _ne(line)) - 1)).otherwise(F.lit(""))
    return F.struct(has.alias("has_range"), F.when(has, F.regexp_extract(whole, DATE_RANGE_PATTERN, 1)).otherwise(F.lit("")).alias("start"),
                    F.when(has, F.regexp_extract(whole, DATE_RANGE_PATTERN, 3)).otherwise(F.lit("")).alias("end"), prefix.alias("prefix"))


def role_header(prefix: Column) -> Column:
    """title/company from the text before a date range; a dash split wins,
    then a comma split, then `` at ``."""
    return split_role(strip_chars(F.trim(_ne(prefix)), ROLE_EDGES))


def split_role(before: Column) -> Column:
    """:func:`role_header` of a text without :data:`ROLE_EDGES` at its ends."""
    dash = F.split(before, r" [—–-] ", 2)
    comma = F.split(before, ",", 2)
    at = F.split(before, " at ", 2)
    has_dash = F.contains(before, F.lit(" — ")) | F.contains(before, F.lit(" - "))
    has_comma = F.contains(before, F.lit(","))
    title = (F.when(has_dash, F.get(dash, 0)).when(has_comma, F.get(comma, 0))
             .otherwise(F.get(at, 0)))
    company = (F.when(has_dash, F.get(dash, 1)).when(has_comma, F.get(comma, 1))
               .otherwise(F.get(at, 1)))
    return F.struct(F.trim(title).alias("title"), F.trim(F.coalesce(company, F.lit(""))).alias("company"))


def normalise_month_year(c: Column) -> Column:
    """T-4: ``MMM YYYY`` / ``Present`` / pass-through."""
    s = F.trim(_ne(c))
    low = F.lower(s)
    num = F.regexp_extract(s, r"^(\d{1,2})[/-](\d{4})$", 1)
    yr_num = F.regexp_extract(s, r"^(\d{1,2})[/-](\d{4})$", 2)
    mon_word = F.regexp_extract(s, r"^([A-Za-z]+)\.?\s+(\d{4})$", 1)
    yr_word = F.regexp_extract(s, r"^([A-Za-z]+)\.?\s+(\d{4})$", 2)
    abbr = F.array(*[F.lit(m) for m in MONTH_ABBR])
    num_mon = F.coalesce(F.try_element_at(abbr, F.when(num.cast("int").between(1, 12),
                                                       num.cast("int"))), F.lit("Jan"))
    full = {m.lower(): m for m in MONTH_ABBR}
    words = {"january": "Jan", "february": "Feb", "march": "Mar", "april": "Apr", "june": "Jun",
             "july": "Jul", "august": "Aug", "sept": "Sep", "september": "Sep",
             "october": "Oct", "november": "Nov", "december": "Dec"}
    full.update(words)
    wmap = F.create_map(*[F.lit(x) for kv in full.items() for x in kv])
    word_mon = F.coalesce(F.try_element_at(wmap, F.lower(mon_word)),
                          F.initcap(F.substring(mon_word, 1, 3)))
    return (F.when(s.isin("", "Present"), s)
            .when(s.rlike(r"^(?:[A-Z][a-z]{2}\s)?\d{4}$"), s)
            .when(low.isin("present", "current", "now"), F.lit("Present"))
            .when(num != "", F.concat_ws(" ", num_mon, yr_num))
            .when(mon_word != "", F.concat_ws(" ", word_mon, yr_word))
            .otherwise(s))


def slug(c: Column, max_chars: int | None = None) -> Column:
    """Non-alphanumerics to ``_``, trimmed, lower-case; an empty slug becomes a
    deterministic content hash (never a clock value). ``max_chars`` cuts the slug; two
    names may then share one, so nothing is cut unless the caller asks."""
    s = F.lower(strip_chars(F.regexp_replace(_ne(c), r"[^A-Za-z0-9]+", "_"), "_"))
    if max_chars is not None:
        s = F.substring(s, 1, max_chars)
    return F.when(s == "", F.concat(F.lit("h"), F.substring(F.sha1(_ne(c)), 1, 12))).otherwise(s)


def html_to_text(c: Column) -> Column:
    """Drop script and style blocks, then tags, then squeeze."""
    t = F.regexp_replace(_ne(c), r"(?i)<script[\s\S]*?</script>", " ")
    t = F.regexp_replace(t, r"(?i)<style[\s\S]*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


FENCE_PATTERN = r"(?i)```(?:json)?\s*([\s\S]*?)```"


def strip_code_fences(c: Column) -> Column:
    """Body of the first fenced block, else the trimmed text."""
    def trimmed(t: Column) -> Column:  # most texts have no blanks at their ends, and need no pattern
        return F.when((F.substring(t, 1, 1) > " ") & (F.substring(t, -1, 1) > " "), t).otherwise(pytrim(t))

    # FENCE_PATTERN by positions: if any fence is closed, the first one is
    s = _ne(c)
    i = F.instr(s, "```")
    j = F.position(F.lit("```"), s, i + 3)
    inside = F.substring(s, i + 3, j - i - 3)
    tag = F.lower(F.substring(inside, 1, 4)) == "json"
    body = F.when(tag, F.substring(inside, F.lit(5), F.length(inside))).otherwise(inside)
    return F.when((i > 0) & (j > 0), trim_blanks(body)).otherwise(trimmed(s))


def left(c: Column, n: int) -> Column:
    return F.substring(_ne(c), 1, n)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(_ne(c)), r"\s+"), lambda w: w != ""))
