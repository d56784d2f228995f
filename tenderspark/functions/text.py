"""Text folding, slugs, content hashes and the query classifier of full-text search."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

#: Latin letters that are no letter with a mark, and what they fold to; fixed values.
LETTERS = {"ß": "ss", "æ": "ae", "ð": "d", "ø": "o", "þ": "th", "đ": "d", "ħ": "h", "ı": "i", "ĸ": "k", "ł": "l", "ŋ": "ng", "œ": "oe", "ŧ": "t"}

#: Cyrillic and Greek letters in Latin ones, and signs as words; fixed values.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch",
    "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "ђ": "dj", "є": "ie", "ѕ": "dz", "і": "i", "ј": "j", "љ": "lj", "њ": "nj",
    "ћ": "tsh", "џ": "dzh",
}
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n",
    "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
SIGNS = {"€": "eur", "§": "ss", "°": "deg", "™": "tm", "‘": "", "’": ""}
#: Cyrillic letters with a mark that do not fold to the letter alone; fixed values.
MARKED = {"ё": "io", "ї": "yi", "ѐ": "ie", "ѓ": "gj", "ќ": "kj"}

#: Blocks whose letters fold to what is left of them without marks: Latin and its extensions, Greek, Cyrillic, further
#: Latin and Greek, ligatures, Roman numerals, and wide forms.
BLOCKS = ((0xAA, 0x250), (0x370, 0x460), (0x1E00, 0x2000), (0x2070, 0x20A0), (0x2150, 0x2190), (0xFB00, 0xFB07), (0xFF10, 0xFF5B))
MARKS = "".join(map(chr, range(0x300, 0x370)))


def _unmarked() -> dict[str, str]:
    """Lower-case letters of the blocks with their bare forms, by compatibility decomposition."""
    out = dict(LETTERS)
    for c in (chr(i) for first, end in BLOCKS for i in range(first, end)):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        bare = "".join(LETTERS.get(x, x) for x in bare)
        if c == c.lower() and c not in LETTERS and bare != c and bare.isalnum():
            out[c] = bare
    return out


FOLDED = _unmarked()


def _put(c: Column, table: dict[str, str]) -> Column:
    """Replace letters: all that become one letter or none in a single pass, and the others only in texts that have some."""
    many = {k: v for k, v in table.items() if len(v) > 1}
    some = {k: v for k, v in table.items() if len(v) == 1}
    gone = MARKS + "".join(k for k, v in table.items() if not v)
    ones = F.translate(c, "".join(some) + gone, "".join(some.values()))
    spelling = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    characters = F.regexp_extract_all(ones, F.lit("(?s)."), F.lit(0))
    spelt = F.array_join(F.transform(characters, lambda x: F.coalesce(F.try_element_at(spelling, x), x)), "")
    return F.when(c.rlike("[" + "".join(many) + "]"), spelt).otherwise(ones)


def _beyond_ascii(c: Column) -> Column:
    """Plain texts skip the replacements."""
    return c.rlike(r"[^\x00-\x7F]")


def fold(c: Column | str) -> Column:
    """Lower case without marks: any Latin, Greek or Cyrillic letter becomes its bare form."""
    low = F.lower(col(c))
    return F.when(_beyond_ascii(low), _put(low, FOLDED)).otherwise(low)


def _latin() -> dict[str, str]:
    """Folded and then transliterated letters, but for the marked ones that have a spelling of their own."""
    other = CYRILLIC | GREEK | SIGNS
    folded = {c: "".join(other.get(x, x) for x in bare) for c, bare in FOLDED.items()}
    return other | folded | MARKED


LATIN = _latin()


def slugify(c: Column | str) -> Column:
    """Latin letters and digits with hyphens between: marks go, Greek and Cyrillic are transliterated, the commas within
    numbers and curly quotes are left out, and common entities are blanks. Other scripts become hyphens."""
    low = F.lower(col(c))
    plain = F.when(_beyond_ascii(low), _put(low, LATIN)).otherwise(low)
    plain = F.regexp_replace(F.regexp_replace(plain, "&(?:amp|lt|gt|quot|nbsp);", " "), r"(?<=\d),(?=\d)", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def amount_text(c: Column) -> Column:
    return F.coalesce(c.cast("decimal(30,6)").cast("string"), F.lit(""))


def content_hash(title: Column, procurer: Column, cpv: Column, estimated: Column, final: Column, published: Column, status: Column, notice_type: Column, awards: Column) -> Column:
    """SHA-256 over nine parts; `awards`: sorted texts ``ico-or-slug:value``."""
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (title, procurer, cpv)] + [amount_text(estimated), amount_text(final)]
    parts += [F.coalesce(x.cast("string"), F.lit("")) for x in (published, status, notice_type)] + [F.array_join(awards, ",")]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *parts), 256))


def notice_hash() -> Column:
    """The content hash of a canonical notice row."""
    texts = F.array_sort(F.transform(F.coalesce("awards", F.array()), lambda a: F.concat(F.coalesce(a["supplier"]["ico"], a["supplier"]["name_slug"], F.lit("")), F.lit(":"), amount_text(a["value"]))))
    return content_hash(F.col("title"), F.coalesce(F.col("procurer.ico"), F.col("procurer.name_slug")), F.col("cpv_code"), F.col("estimated_value"), F.col("final_value"), F.col("publication_date"), F.col("status"), F.col("notice_type"), texts)


def classify(query: str | None) -> str:
    """exists, phrase, wildcard or compound."""
    q = (query or "").strip()
    if not q:
        return "exists"
    if len(q) > 2 and q[0] == q[-1] == '"':
        return "phrase"
    at = min((q.index(m) for m in "*?" if m in q), default=-1)
    return "wildcard" if at >= 3 else "compound"


def fold_text(q: str) -> str:
    """What `fold` makes of a query."""
    return q.lower().translate(str.maketrans(FOLDED | dict.fromkeys(MARKS, "")))


def query_words(query: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold_text(query))


def phrase(field: Column | str, query: str) -> Column:
    words = " ".join(query_words(query))
    return F.concat(F.lit(" "), F.array_join(tokens(field), " "), F.lit(" ")).contains(f" {words} ")


def wildcard_pattern(folded: str) -> str:
    """The regular expression that a whole token matches."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in folded) + "$"


def wildcard(field: Column | str, query: str) -> Column:
    pattern = wildcard_pattern(fold_text(query))
    return F.exists(tokens(field), lambda t: t.rlike(pattern))


def fuzzy_edits(word: str) -> int:
    return 1 if len(word) < 6 else 2


def fuzzy(field: Column | str, query: str) -> Column:
    """Some token of the field is within one edit of some word of the query, two from six characters on."""
    found = F.lit(False)
    for w in query_words(query):
        found = found | _within(field, w, fuzzy_edits(w))
    return found


def _within(field: Column | str, word: str, edits: int) -> Column:
    return F.exists(tokens(field), lambda t: F.levenshtein(t, F.lit(word), edits) >= 0)


def prefix(field: Column | str, query: str) -> Column:
    q = fold_text(query.strip())
    return F.exists(tokens(field), lambda t: t.startswith(q))


#: Lengths of the beginnings that autocompletion knows; fixed values.
GRAMS = (2, 15)


def near_prefix(field: Column | str, query: str) -> Column:
    """Each word of the query is within one edit of a beginning of some token; shorter words than a gram have no match."""
    words = [w[: GRAMS[1]] for w in query_words(query)]
    found = F.lit(bool(words) and min(map(len, words)) >= GRAMS[0])
    for w in words:
        found = found & F.exists(tokens(field), _near_beginning(w))
    return found


def _near_beginning(word: str) -> Callable[[Column], Column]:
    sizes = [n for n in (len(word) - 1, len(word), len(word) + 1) if GRAMS[0] <= n <= GRAMS[1]]

    def near(t: Column) -> Column:
        hit = F.lit(False)
        for n in sizes:
            hit = hit | ((F.length(t) >= n) & (F.levenshtein(F.substring(t, 1, n), F.lit(word), 1) >= 0))
        return hit

    return near


#: Weights of the parts of a compound query.
WEIGHTS = {"phrase": 3.0, "fuzzy": 1.0, "autocomplete": 1.0}


def matches(query: str | None, *fields: str) -> Column:
    """The predicate that a query string stands for over some fields."""
    kind, q = classify(query), (query or "").strip()
    if kind == "exists":
        return F.col(fields[0]).isNotNull()
    out = F.lit(False)
    for f in fields:
        if kind == "phrase":
            hit = phrase(f, q[1:-1])
        elif kind == "wildcard":
            hit = wildcard(f, q)
        else:
            hit = phrase(f, q) | fuzzy(f, q) | prefix(f, q)
        out = out | F.coalesce(hit, F.lit(False))
    return out


def score(query: str, *fields: str) -> Column:
    out = F.lit(0.0)
    for f in fields:
        for kind, test in (("phrase", phrase), ("fuzzy", fuzzy), ("autocomplete", prefix)):
            out = out + F.when(test(f, query), WEIGHTS[kind]).otherwise(0.0)
    return out
