"""Text functions as Column builders: they stay in the JVM and inside code generation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words of Portuguese and English, abbreviations, language markers.
STOPWORDS_PT = (
    "a o as os um uma uns umas de do da dos das em no na nos nas por para pelo pela pelos pelas com sem sobre entre ate apos ante sob este esta estes estas esse essa esses essas aquele "
    "aquela aqueles aquelas isso isto aquilo qual quais quando onde porque como eu tu voce voces vos lhe lhes me te se ja nao sim mas ou e seja ser estar ter haver fazer muito mais menos todo "
    "toda todos todas outro outra algo algum alguma cada ainda entao apenas deve deve-se quero preciso tal vez logo desde atraves mesmo assim depois antes agora aqui ali la sempre nunca so"
).split()
STOPWORDS_EN = (
    "the a an and or but if then else of in on at to for from by with without about into over under between among during before after above below up down out off again further once here there "
    "when where why how all any both each few most other some such no nor not only own same so than too very can will just should now is are was were be been being have has had do does did "
    "doing would could may might must shall it its this that these those i me my we our you your he him his she her they them their what which who whom as because while against through "
    "including within upon toward"
).split()
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Sra", "vs", "etc", "e\\.g", "i\\.e", "Art", "Fig")
PT_MARKERS = "de que nao para com uma por dos das como mais mas foi voce sao seu sua ou os as um isso esta ele ela nos ja muito quando onde porque qual pelo pela ate entre sobre se e ao aos a".split()
EN_MARKERS = "the of and to in is you that it for on with as are this from at be have has was were what when where which how why not but".split()

STOPWORDS = sorted({*STOPWORDS_PT, *STOPWORDS_EN})


def _letters() -> tuple[str, str]:
    """Lower-case letters of the basic plane that are one other letter once decomposed and without marks U+0300 to U+036F; then the marks, which have none."""
    found = []
    for c in map(chr, (*range(0xC0, 0xD800), *range(0xE000, 0xFFFE))):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if x not in _MARKS)
        if c == c.lower() and plain != c and len(plain) == 1:
            found.append((c, plain.lower()))
    return "".join(c for c, _ in found) + _MARKS, "".join(p for _, p in found)


_MARKS = "".join(map(chr, range(0x300, 0x370)))
_ACCENTED, _PLAIN = _letters()
MASK, CUT = "\uE000", "\uE001"  # private-use characters that no text has


def fold(s: Column) -> Column:
    """Lower case without accents, composed or not. Letters that decompose to several, such as Hangul syllables, stay whole."""
    return F.translate(F.lower(s), _ACCENTED, _PLAIN)


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def truncate(s: Column, most: int) -> Column:
    return F.when(F.length(s) > most, F.concat(F.regexp_replace(F.substring(s, 1, most - 1), r"\s+$", ""), F.lit("…"))).otherwise(s)


def estimate_tokens(s: Column) -> Column:
    return F.ceil(F.length(s) / 4).cast("int")


def words(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"(\p{L}[\p{L}\p{M}\p{N}'’-]*|\p{N}+)"), F.lit(1))


def sentences(s: Column) -> Column:
    """Sentences end at . ! or ? before white space, or at an empty line; abbreviations and decimals don't end one."""
    s = F.regexp_replace(s, rf"(?i)\b({'|'.join(ABBREVIATIONS)})\.", f"$1{MASK}")
    s = F.regexp_replace(F.regexp_replace(s, r"(\d)\.(\d)", f"$1{MASK}$2"), r"([.!?])\s+", f"$1{CUT}")
    parts = F.split(F.regexp_replace(s, r"\n{2,}", CUT), CUT)
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(F.replace(x, F.lit(MASK), F.lit(".")), r"^\s+|\s+$", "")), lambda x: x != "")


def is_stopword(s: Column) -> Column:
    return s.isin(STOPWORDS)


def stem(s: Column) -> Column:
    """Light suffix rules in order; the first that fits decides."""
    n, cut = F.length(s), lambda k: F.substring(s, F.lit(1), F.length(s) - k)
    return (
        F.when(n < 5, s)
        .when(s.endswith("coes") & (n > 6), F.concat(cut(4), F.lit("cao")))
        .when(s.endswith("mente") & (n > 7), cut(5))
        .when(s.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y")))
        .when(s.endswith("ing") & (n > 5), cut(3))
        .when(s.endswith("ed") & (n > 5), cut(2))
        .when(s.rlike("(x|z|s|ch|sh)es$"), cut(2))
        .when(s.endswith("s") & ~s.endswith("ss") & ~s.rlike("[aeiou]s$"), cut(1))
        .otherwise(s)
    )


def raw_words(s: Column) -> Column:
    """What raw_terms folds."""
    return F.split(s, r"[^\p{L}\p{N}+#._-]+")


def raw_terms(s: Column) -> Column:
    """Folded terms of a text before stop words go; c++, c# and node.js stay whole."""
    parts = F.transform(raw_words(s), lambda x: F.regexp_replace(fold(x), "^[._-]+|[._-]+$", ""))
    return F.filter(parts, lambda x: (x != "") & (F.length(x) <= 40))


def quoted(s: Column) -> Column:
    """Quoted phrases of 2 to 120 characters."""
    return F.filter(F.transform(F.regexp_extract_all(s, F.lit('"([^"]{2,120})"'), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def query_terms(s: Column) -> Column:
    """Distinct terms of a query: those of its phrases, then of what stands outside quotes; not stemmed."""
    text = F.concat_ws(" ", F.concat_ws(" ", quoted(s)), F.regexp_replace(s, '"[^"]*"', " "))
    return F.array_distinct(F.filter(raw_terms(text), lambda x: ~is_stopword(x)))


def detect_language(s: Column) -> Column:
    """pt, en or und, by function words: one side needs 1.2 times the other's."""
    tokens = F.filter(F.split(fold(s), r"\s+"), lambda x: x != "")
    pt, en = F.size(F.filter(tokens, lambda x: x.isin(PT_MARKERS))), F.size(F.filter(tokens, lambda x: x.isin(EN_MARKERS)))
    return F.when((pt == 0) & (en == 0), "und").when(pt >= en * 1.2, "pt").when(en >= pt * 1.2, "en").otherwise("und")


def content_terms(s: Column) -> Column:
    """Distinct folded words of over three characters that are no stop words."""
    return F.array_distinct(F.filter(F.transform(words(s), fold), lambda x: (F.length(x) > 3) & ~is_stopword(x)))


def first_non_empty(*values: Column) -> Column:
    """The first value that isn't blank, as it is."""
    return F.coalesce(*(F.when(~v.rlike(r"^\s*$"), v) for v in values))


def strip_fence(s: Column) -> Column:
    """What stands in a fence of a text that begins with one; other texts trimmed."""
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    return F.when(s.startswith("```"), F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(?i)^```[a-z]*\n?", ""), r"```$", ""), r"^\s+|\s+$", "")).otherwise(s)


def first_json(s: Column) -> Column:
    """The text itself if it is JSON, else from its first { to its last } if that is; null if neither."""
    inner = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.when(F.try_parse_json(s).isNotNull(), s), F.when(F.try_parse_json(inner).isNotNull(), inner))


def query_key(s: Column) -> Column:
    """Queries with one key are the same query."""
    return F.trim(F.regexp_replace(F.lower(s), r"(?U)\s+", " "))


def query_variants(query: Column, variants: Column, most: int) -> Column:
    """The query, then variants of 3 to 300 characters, `most` of them, without repeats."""
    fit = F.filter(F.transform(F.coalesce(variants, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.length(x).between(3, 300))
    given = F.filter(F.concat(F.array(F.trim(query)), F.slice(fit, 1, most)), lambda x: query_key(x) != "")
    keys = F.transform(given, query_key)
    return F.filter(given, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)


def content_words(s: Column) -> Column:
    """Stemmed words of over two characters that are no stop words, with repeats."""
    return F.transform(F.filter(F.split(fold(s), r"[^\p{L}\p{N}]+"), lambda x: (F.length(x) > 2) & ~is_stopword(x)), stem)


def plain_markdown(s: Column) -> Column:
    """Text of markdown: no images, links as their text, no list marks or signs."""
    for pattern, to in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s*[-*+]\s+", ""), (r"[*_`>#]", ""), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"^\s+|\s+$", "")):
        s = F.regexp_replace(s, pattern, to)
    return s


def round_half_up(x: Column, digits: int = 4) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits."""
    return F.floor(x * 10.0**digits + 0.5) / F.lit(10.0**digits)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 if a side has no length."""
    n = F.least(F.size(a), F.size(b))
    a, b = (F.transform(F.slice(x, F.lit(1), n), lambda y: y.cast("double")) for x in (a, b))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, y: t + y)
    dot, aa, bb = total(F.zip_with(a, b, lambda x, y: x * y)), total(F.transform(a, lambda x: x * x)), total(F.transform(b, lambda x: x * x))
    return F.when((aa == 0) | (bb == 0), 0.0).otherwise(dot / (F.sqrt(aa) * F.sqrt(bb)))
