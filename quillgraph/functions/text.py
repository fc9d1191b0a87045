"""Text rules as column expressions. Five normalizers and tokenizers exist side by side and are not the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and limits that results depend on.
STOPWORDS = (
    "a an the of to in on for from by with and or is are be this that these those as at into via "
    "module modules component components block blocks stage stages layer layers step steps unit units diagram figure system"
).split()
KEYWORD_STOPWORDS = "the and for with from into over this that these those are is be".split()
DOMAINS = {
    "architecture": "encoder decoder attention embedding token transformer layer projection head block router routing expert ffn rope".split(),
    "evaluation": "evaluation metric metrics benchmark judge scenario response score scores criteria".split(),
    "system": "retrieval memory cache database query pipeline system storage index".split(),
}
SUFFIXES = {w: w for w in "block layer module network encoding embedding attention head decoder encoder projection router routing mask length".split()}
SUFFIXES |= {"score": "score", "scores": "score", "state": "state", "states": "state", "token": "token", "tokens": "token"}
CONNECTIVES = (" inside ", " immediately after ", " immediately before ", " between ")
LONGEST = 90


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def domain_word(x: Column) -> Column:
    """Whether a text has a word of any domain among its tokens."""
    return F.lower(x).rlike(f"(?<![A-Za-z0-9])({'|'.join(w for words in DOMAINS.values() for w in words)})(?![A-Za-z0-9])")


def clean(x: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def norm_key(x: Column) -> Column:
    return F.lower(clean(x))


def reply_norm(x: Column) -> Column:
    """Lower case, everything but word characters as blanks, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("([A-Za-z0-9]+)"), 1)


def delimited(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"[^\s\-/_,:;()]+"), F.lit(0))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def keywords(x: Column) -> Column:
    """Distinct parts of three characters or more that are no stopwords."""
    return F.array_distinct(F.filter(delimited(F.lower(x)), lambda t: (F.length(t) >= 3) & ~t.isin(*KEYWORD_STOPWORDS)))


def domains(words: Column) -> Column:
    """Domains that any of the words belongs to; `unknown` is a domain of its own."""
    has = lambda w, v: F.exists(w, lambda t: t.isin(*v))
    found = lambda w: F.filter(F.array(*[F.when(has(w, v), k) for k, v in DOMAINS.items()]), lambda d: d.isNotNull())
    some = [w for v in DOMAINS.values() for w in v]
    return let(words, lambda w: F.when(has(w, some), found(w)).otherwise(F.array(F.lit("unknown"))))


def suffix_type(x: Column) -> Column:
    last = F.lower(F.element_at(F.split(x, " "), -1))
    pairs = F.create_map(*[F.lit(v) for kv in SUFFIXES.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, last), F.lit("other"))


def signature(x: Column) -> Column:
    """Style of a text (already cleaned)."""
    return F.struct(
        F.size(delimited(x)).alias("token_count"), F.length(x).alias("char_length"), F.contains(x, F.lit("-")).alias("has_hyphen"),
        suffix_type(x).alias("suffix_type"), keywords(x).alias("keywords"),
    )


def score(t: Column, c: Column, hint: Column, own: Column) -> Column:
    """How well a candidate with signature c goes with a target t in a graph of the domains hint."""
    return score_fitting(t, c, any_of(own, hint), in_common(t["keywords"], c["keywords"]))


def in_common(a: Column, b: Column) -> Column:
    """How many of the distinct, few words a are in b: for arrays so short no set is worth making."""
    return F.size(F.filter(a, lambda w: F.array_contains(b, w)))


def any_of(a: Column, b: Column) -> Column:
    """Whether one of the few words a is in b."""
    return F.exists(a, lambda w: F.array_contains(b, w))


def score_sharing(t: Column, c: Column, hint: Column, own: Column, shared: Column) -> Column:
    """score() of a candidate with so many keywords in common with the target; it grows with their number."""
    return score_fitting(t, c, any_of(own, hint), shared)


def score_fitting(t: Column, c: Column, fits: Column, shared: Column) -> Column:
    """score_sharing() where it is known whether the candidate has a domain of the graph."""
    known = (t["suffix_type"] != "other") & (c["suffix_type"] != "other")
    return (
        F.lit(0.0)
        - F.abs(t["token_count"] - c["token_count"]) * 1.2
        - F.abs(t["char_length"] - c["char_length"]) * 0.08
        + F.when(t["has_hyphen"] == c["has_hyphen"], 0.8).otherwise(0.0)
        + F.when((t["suffix_type"] == c["suffix_type"]) & known, 2.5).when(known, 0.5).otherwise(0.0)
        + shared * 0.8
        + F.when(fits, 1.5).otherwise(0.0)
        + F.when(c["token_count"] <= 6, 0.5).otherwise(-0.5)
    )


def safe(x: Column) -> Column:
    """Fit for a question: not empty, not long, each connective at most once."""
    ok = (x != "") & (F.length(x) <= LONGEST)
    for c in CONNECTIVES:
        ok = ok & (F.length(x) - F.length(F.replace(x, F.lit(c), F.lit(""))) <= len(c))
    return ok
