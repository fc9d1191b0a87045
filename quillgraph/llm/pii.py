"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the matches of the base patterns (e-mail, IP, card, phone), the ones among them that fail their
check, phone numbers in national form and e-mail addresses that are spelled out. Four labelers vote on each
candidate: its regex check, a gazetteer (known endings, prefixes, country codes), and words in the 40 characters
before it and in the 40 after it. For each kind, expectation-maximisation over the counts of vote patterns
estimates how reliable every labeler is; the posteriors then train the final classifier, naive Bayes over the
votes, the length and what stands next to the span on either side. Base spans always stay; the classifier adds
others.

Text positions come from markers that regexp_replace puts around matches. Patterns are written without
repeated groups, so long texts neither overflow Java's stack nor go quadratic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import saved

KINDS = ("email", "ip", "card", "phone")
AROUND = 40
ROUNDS = 50
LABELERS = 4
#: Values that a feature of the classifier can take.
FEATURES = {"size": 8, "left": 4, "right": 4}
#: Parts of a text that are summed, and spans that are looked through, together.
LOT = 128
SPAN = "struct<start:int,end:int,span:string,before:string>"
OPEN, CLOSE, STAND_IN = "\ue000", "\ue001", "\ue002"
#: Gazetteers and context words of the labelers.
ENDINGS = r"(?i)\.(com|org|net|edu|gov|io|info|biz|example|de|fr|es|uk|eu|test)$"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6)"
AREAS = r"^[2-9]"
COUNTRIES = r"^(1|33|34|44|49|7|81|86|91|39|41|43|31|32)"
CUES = {
    "email": r"(?i)mail|contact|write|reach|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|server|host|addr|login|log ",
    "card": r"(?i)card|visa|credit|karte|tarjeta|carte|pay",
    "phone": r"(?i)phone|call|tel|fon|mobil|fax|contact",
}
DOMAIN = "A-Za-z0-9-"
LOCAL = "A-Za-z0-9._%+-"


def _parts(text: Column, pattern: str) -> Column:
    """Text between and inside of the matches, by turns."""
    return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lots(items: Column) -> Column:
    """An array in slices of LOT items. What appends to an array, or looks through it, does so within a slice."""
    count = F.ceil(F.size(items) / LOT).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(items, k * LOT + 1, F.lit(LOT))))


def _starts(parts: Column) -> Column:
    """Where each part starts: sums of lengths by slice, then within each."""
    ints = F.array().cast("array<int>")
    add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["found"], acc["at"]).alias("found"))
    upto = lambda lengths, at: F.aggregate(lengths, F.struct(at.alias("at"), ints.alias("found")), add, lambda acc: acc["found"])

    def within(lots: Column) -> Column:
        sums = F.transform(lots, lambda lot: F.aggregate(lot, F.lit(0), lambda a, p: a + F.length(p)))
        return let(upto(sums, F.lit(0)), lambda first: F.flatten(F.transform(lots, lambda lot, k: upto(F.transform(lot, F.length), F.get(first, k)))))

    return let(_lots(parts), within)


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, span, before, after>> of the matches, with the text just ahead and just behind."""

    def found(parts: Column, starts: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: (i % 2 == 1) & (i < F.size(parts)))
        return F.transform(
            at,
            lambda i: F.struct(
                F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(F.get(parts, i))).alias("end"), F.get(parts, i).alias("span"), F.right(F.get(parts, i - 1), F.lit(AROUND)).alias("before"),
                F.left(F.coalesce(F.get(parts, i + 1), F.lit("")), F.lit(AROUND)).alias("after"),
            ),
        )

    # the parts are between and inside of the matches, by turns, and are made once
    return let(_parts(text, pattern), lambda parts: let(_starts(parts), lambda starts: found(parts, starts)))


def _apart(more: Column, base: Column) -> Column:
    """The spans of `more` that overlap none of `base`, which are in order and apart: slices of base first."""
    meets = lambda m, s: (s["start"] < m["end"]) & (m["start"] < s["end"])
    whole = lambda lot: F.struct(F.element_at(lot, 1)["start"].alias("start"), F.element_at(lot, -1)["end"].alias("end"))
    none = lambda m, lots: ~F.exists(lots, lambda lot: meets(m, whole(lot)) & F.exists(lot, lambda s: meets(m, s)))
    return F.when((F.size(more) == 0) | (F.size(base) == 0), more).otherwise(let(_lots(base), lambda lots: F.filter(more, lambda m: none(m, lots))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _candidates(text: Column) -> dict[str, Column]:
    """By kind: array<struct<start, end, span, before, after, ok>> of all matches of the base pattern."""
    # a dot that is not between two domain characters ends a domain; in a local part any stand-in will do
    dots = F.regexp_replace(text, rf"(?<![{DOMAIN}])\.|\.(?![{DOMAIN}])", "_")
    email = F.when(F.contains(text, F.lit("@")), _spans(dots, rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{DOMAIN}]++\.[{DOMAIN}.]++"))
    ip = F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _spans(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"))
    # a separator that is not between two digits ends a number
    single = F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "_")
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), _spans(single, r"[0-9][0-9\x20-]++"))
    phone = F.when(text.rlike(r"\+[0-9]"), _spans(text, r"\+[0-9][\x20().0-9-]+[0-9]"))
    ok = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.forall(F.split(s, r"\."), lambda p: p.cast("double") <= 255),
        "card": lambda s: F.length(_digits(s)).between(16, 19) & _luhn(_digits(s)),
        "phone": lambda s: F.length(_digits(s)).between(8, 15),
    }
    return {k: _checked(x, ok[k]) for k, x in {"email": email, "ip": ip, "card": card, "phone": phone}.items()}


def _checked(spans: Column, check: Callable[[Column], Column]) -> Column:
    none = F.array().cast(f"array<{SPAN[:-1]},after:string>>")
    return F.transform(F.coalesce(spans, none), lambda s: s.withField("ok", check(s["span"])))


def _national(text: Column) -> Column:
    """Phone numbers without a country code."""
    pattern = r"(?<![0-9+.\x20()-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])|(?<=[A-Za-z:,;]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
    return _checked(F.when(text.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}"), _spans(text, pattern)), lambda s: F.lit(False))


def _spelled(text: Column) -> Column:
    """E-mail addresses with `at` in brackets."""
    pattern = rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}\x20?[\[(]at[\])]\x20?[{DOMAIN}]{{1,63}}(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z]{{2,12}}(?![{DOMAIN}])"
    return _checked(F.when(text.rlike(r"[\[(]at[\])]"), _spans(text, pattern)), lambda s: F.lit(False))


def _side(char: Column) -> Column:
    """What stands next to a span: nothing, a letter, a digit, anything else."""
    return F.when(char == "", 0).when(char.rlike(r"\p{L}"), 1).when(char.rlike("[0-9]"), 2).otherwise(3)


def _voted(kind: str, spans: Column, countries: str = COUNTRIES) -> Column:
    """struct<kind, start, end, base, votes, size, left, right>: votes are bits of regex, gazetteer and the context
    before and after. countries is the pattern of how digits of a phone number start."""
    known = {
        "email": lambda s: s.rlike(ENDINGS),
        "ip": lambda s: ~s.rlike(r"^(0|22[4-9]|2[3-9][0-9]|[0-9]{4,})"),
        "card": lambda s: _digits(s).rlike(ISSUERS),
        "phone": lambda s: _digits(s).rlike(countries),
    }[kind]
    bit = lambda c, n: F.when(c, n).otherwise(0)
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["ok"].alias("base"),
            (bit(s["ok"], 1) + bit(known(s["span"]), 2) + bit(s["before"].rlike(CUES[kind]), 4) + bit(s["after"].rlike(CUES[kind]), 8)).alias("votes"),
            F.least(F.floor((s["end"] - s["start"]) / 4).cast("int"), F.lit(7)).alias("size"), _side(F.right(s["before"], F.lit(1))).alias("left"), _side(F.left(s["after"], F.lit(1))).alias("right"),
        ),
    )


def _chance(votes: Column, p: Column) -> Column:
    """Posterior of a vote pattern under p: prior, and each labeler's rate of votes given yes and given no."""
    yes, no = p["prior"], 1 - p["prior"]
    for i in range(LABELERS):
        voted = votes.bitwiseAND(1 << i) > 0
        yes = yes * F.when(voted, p["yes"][i]).otherwise(1 - p["yes"][i])
        no = no * F.when(voted, p["no"][i]).otherwise(1 - p["no"][i])
    return yes / (yes + no)


def reliabilities(patterns: DataFrame) -> DataFrame:
    """kind, p(prior, yes, no) by expectation-maximisation over (kind, votes, n); all rates are smoothed by one."""
    first = F.struct(F.lit(0.7).alias("prior"), F.array(*map(F.lit, (0.9, 0.8, 0.6, 0.6))).alias("yes"), F.array(*map(F.lit, (0.2, 0.4, 0.2, 0.2))).alias("no"))

    def step(p: Column, _: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("all"), F.array(*[F.lit(0.0)] * LABELERS).alias("yes"), F.array(*[F.lit(0.0)] * LABELERS).alias("no"))

        def add(acc: Column, x: Column) -> Column:
            w = x["n"] * _chance(x["votes"], p)
            on = lambda i: F.when(x["votes"].bitwiseAND(1 << i) > 0, 1.0).otherwise(0.0)
            return F.struct(
                (acc["w"] + w).alias("w"), (acc["all"] + x["n"]).alias("all"),
                F.array(*[acc["yes"][i] + w * on(i) for i in range(LABELERS)]).alias("yes"), F.array(*[acc["no"][i] + (x["n"] - w) * on(i) for i in range(LABELERS)]).alias("no"),
            )

        def rates(acc: Column) -> Column:
            return F.struct(
                ((acc["w"] + 1) / (acc["all"] + 2)).alias("prior"),
                F.array(*[(acc["yes"][i] + 1) / (acc["w"] + 2) for i in range(LABELERS)]).alias("yes"),
                F.array(*[(acc["no"][i] + 1) / (acc["all"] - acc["w"] + 2) for i in range(LABELERS)]).alias("no"),
            )

        return F.aggregate(F.col("patterns"), zero, add, rates)

    rows = patterns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))
    return rows.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, step).alias("p"))


def accepted_cells(candidates: DataFrame) -> DataFrame:
    """kind, votes and features of the cells (8192 at most) that the final classifier accepts."""
    cells = saved(candidates.groupBy("kind", "votes", *FEATURES).agg(F.count("*").alias("n")))
    p = reliabilities(cells.groupBy("kind", "votes").agg(F.sum("n").alias("n")))
    x = cells.join(p, "kind").withColumn("c", F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), _chance(F.col("votes"), F.col("p")))))
    yes, no = F.sum(F.col("n") * F.col("c")), F.sum(F.col("n") * (1 - F.col("c")))
    made = saved(x.drop("p"))
    x = made.join(made.groupBy("kind").agg(yes.alias("ys"), no.alias("zs")), "kind")
    odds = F.log(F.col("c") / (1 - F.col("c")))
    for name, values in FEATURES.items():
        own = made.groupBy("kind", name).agg(yes.alias(f"y_{name}"), no.alias(f"z_{name}"))
        x = x.join(own, ["kind", name])
        odds = odds + F.log((F.col(f"y_{name}") + 1) / (F.col("ys") + values)) - F.log((F.col(f"z_{name}") + 1) / (F.col("zs") + values))
    return x.filter(odds > 0).select("kind", "votes", *FEATURES)


def _cell(s: Column | Row) -> Column | int:
    """The number of a cell, of a span or of a row of accepted_cells()."""
    out = s["kind"] * (1 << LABELERS) + s["votes"]
    for name, values in FEATURES.items():
        out = out * values + s[name]
    return out


def _written(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Positions are code points, ends exclusive. A null text is empty and has no spans. Each row is judged by
    itself with the labelers' reliabilities from all rows; repeated rows give repeated results. Added spans
    do not overlap base spans of their kind.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    clean = F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)), F.translate(text, OPEN + CLOSE, STAND_IN * 2)).otherwise(text)
    x = docs.select(F.col("doc_id"), clean.alias("t"))
    found = _candidates(F.col("t"))
    x = x.select("doc_id", *[_voted(k, found[k]).alias(k) for k in KINDS], _voted("phone", _national(F.col("t")), AREAS).alias("national"), _voted("email", _spelled(F.col("t"))).alias("spelled"))
    x = saved(x.select("doc_id", F.concat(*KINDS, _apart(F.col("national"), F.col("phone")), _apart(F.col("spelled"), F.col("email"))).alias("found")))
    cells = accepted_cells(x.select(F.explode("found").alias("s")).select("s.kind", "s.votes", *[f"s.{f}" for f in FEATURES])).collect()
    keys = F.array(*[F.lit(_cell(r)) for r in cells]).cast("array<int>")
    added = F.filter("found", lambda s: ~s["base"] & F.array_contains(keys, _cell(s)))
    order = lambda c: F.array_sort(F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    x = x.select("doc_id", F.filter("found", lambda s: s["base"]).alias("base"), added.alias("added"))
    of_kind = lambda i: F.filter("base", lambda s: s["kind"] == i)
    n = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return x.select(
        "doc_id", *n, F.sha2(_written(order(F.col("base"))).cast("binary"), 256).alias("base_sha256"),
        _written(order(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
