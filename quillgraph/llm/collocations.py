"""Collocations: phrases of two to four words that occur far more often than their parts let expect.

Words that are frequent enough get a number, and texts become runs of numbers that break at marks and at other
words. The n-grams of a run are packed into keys of 16 bytes (four numbers, zero where the phrase is shorter). A task
sorts its keys by radix and counts runs of equal ones; what is left is dealt by ranges of keys, sorted, and run
lengths are added up. Two passes: pairs first, then the three and four words whose pairs are all frequent, which a
bitmap of fixed size tells (a pair that it takes for another only costs a key more).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import numbered
from .common import chunks, give_back, mix64, saved, utf8

LEAST = 30
LONGEST = 4
FIRST = 2000
#: A phrase goes if a longer one has this percentage of its occurrences.
WITHIN = 80
#: The most frequent words, which every task holds; the others are looked up by a join.
HEAD = 1 << 19
#: Bits of a bitmap that every task holds.
BITS = 1 << 26
#: Bytes of text, words and keys that are worked on together.
STRETCH, DISTINCT, KEYS = 4 << 20, 250_000, 1_000_000
#: Keys that are handed on together.
LOT = 65_536
#: The first of two steps to a language's best phrases works on so many parts of each language.
PARTS = 256

BREAK = b"\n"
#: Letters A to Z in lower case, marks and line ends as breaks, tabs as spaces.
READ = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of UTF-8 text with BREAK between its pieces (and empty strings, which count for nothing), in
    stretches that end between words."""
    at = 0
    while at < len(raw):
        end = at + STRETCH
        if end < len(raw):
            end = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end)) + 1 or min(x for x in (raw.find(b" ", end), raw.find(b"\n", end), len(raw)) if x >= 0)
        yield raw[at:end].translate(READ).replace(BREAK, b" \n ").split(b" ")
        at = max(end, at + 1)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Texts of one language together, about a megabyte at a time."""
    data, bounds = utf8(batch.column("text"))
    langs = batch.column("lang").to_pylist()
    for row, end in chunks(bounds):
        own: dict[str, list[bytes]] = {}
        for i in range(row, end):
            own.setdefault(langs[i], []).append(data[bounds[i] : bounds[i + 1]].tobytes())
        for lang, texts in own.items():
            yield lang, b"\n".join(texts)


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, n over all texts; a task sends a word once for each DISTINCT words that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, count in met.items():
                count.pop(b"", None)
                count.pop(BREAK, None)
                found = pa.array(list(count), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), found, pa.array(list(count.values()), pa.int64())], ["lang", "word", "n"])
            met.clear()
            give_back()

        for batch in batches:
            for lang, raw in _by_lang(batch):
                for some in words(raw):
                    met.setdefault(lang, Counter()).update(some)
                if sum(map(len, met.values())) > DISTINCT:
                    yield from out()
        yield from out()

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bitmap(positions: DataFrame) -> np.ndarray:
    """The bits at positions (column `at`, below BITS) as bytes."""
    bucket = F.floor(F.col("at") / 32768).alias("bucket")
    found = positions.groupBy(bucket).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).toPandas()  # BITS / 32768 rows at most
    made = np.zeros((max(1, BITS // 32768), 4096), np.uint8)
    for k, bits in zip(found["bucket"], found["bits"], strict=True):
        made[k] = np.frombuffer(bits, np.uint8)
    return made.reshape(-1)


def held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _tail_place(lang: Column, word: Column) -> Column:
    return F.crc32(F.concat(lang, F.lit("\n"), word).cast("binary")) % BITS


def _runs(ids: np.ndarray) -> np.ndarray:
    """ids without what can be in no pair: words that stand alone, and breaks beside breaks. Words to be looked up
    yet (below 0) stay."""
    word = ids != 0
    beside = np.zeros(len(ids), bool)
    beside[1:] |= word[:-1]
    beside[:-1] |= word[1:]
    ids = ids[word & beside | ~word]
    return ids[np.append(True, (ids[1:] != 0) | (ids[:-1] != 0))] if len(ids) else ids


def sequences(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """seq (32-bit numbers, 0 for a break) over all texts."""
    spark = rows.sparkSession
    head = dictionary.filter(F.col("id") <= HEAD).select("lang", "word", "id").toPandas()
    table: dict[str, dict[bytes, int]] = {}
    for lang, word, i in zip(head["lang"], head["word"], head["id"].tolist(), strict=True):
        table.setdefault(lang, {})[word.encode()] = i
    tail = dictionary.filter(F.col("id") > HEAD)
    more = len(head) == HEAD and not tail.isEmpty()
    bits = bitmap(tail.select(_tail_place(F.col("lang"), F.col("word")).alias("at"))) if more else None
    del head
    shared = spark.sparkContext.broadcast((table, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = shared.value
        for batch in batches:
            for lang, raw in _by_lang(batch):
                own, met, asked, parts = table.get(lang, {}), {BREAK: 0}, [], []
                prefix = f"{lang}\n".encode()
                for some in words(raw):
                    some = list(filter(None, some))
                    ids = np.fromiter(map(own.get, some, repeat(0)), np.int32, len(some))
                    if bits is not None:
                        for at in np.flatnonzero(ids == 0).tolist():
                            if (w := some[at]) not in met:
                                fit = bool(held(bits, np.array([zlib.crc32(prefix + w) % (8 * len(bits))]))[0])
                                asked += [w.decode()] * fit
                                met[w] = -len(asked) * fit
                            ids[at] = met[w]
                    parts.append(ids)
                seq = _runs(np.concatenate(parts)) if parts else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_pydict({
                    "seq": pa.array([seq.tobytes()], pa.binary()), "lang": pa.array([lang], pa.string()),
                    "words": pa.array([asked], pa.list_(pa.string())),
                })
            give_back()

    made = saved(rows.mapInArrow(run, "seq binary, lang string, words array<string>").filter(F.octet_length("seq") > 0))
    return saved(_looked_up(made, tail)) if more else made.select("seq")


def _looked_up(made: DataFrame, tail: DataFrame) -> DataFrame:
    """seq with the numbers of the words that are not in the head; those in no dictionary become breaks."""
    made = saved(made.withColumn("lot", F.monotonically_increasing_id()))
    asked = made.select("lot", "lang", F.posexplode("words").alias("k", "word"))
    found = asked.join(tail.select("lang", "word", "id"), ["lang", "word"]).groupBy("lot").agg(F.collect_list("k").alias("ks"), F.collect_list("id").alias("ids"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, n, ks, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "ks", "ids")), strict=True):
                s, number = np.frombuffer(seq, np.int32), np.zeros(n + 1, np.int32)
                if ks:
                    number[np.array(ks) + 1] = ids
                out.append(_runs(np.where(s < 0, number[np.maximum(-s, 0)], s)).tobytes())
            yield pa.RecordBatch.from_pydict({"seq": pa.array(out, pa.binary())})

    # collect_list of both in one aggregate keeps them side by side
    return made.join(found, "lot", "left").select("seq", F.size("words").alias("n"), "ks", "ids").mapInArrow(put, "seq binary")


def radix_order(ids: np.ndarray) -> np.ndarray:
    """The order of rows of numbers, by their digits of 16 bits from the last to the first."""
    order = np.arange(len(ids))
    for k in reversed(range(ids.shape[1])):
        for digit in (ids[:, k].astype(np.uint16), (ids[:, k] >> 16).astype(np.uint16)):
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ids in order, and how often each occurs."""
    if not len(ids):
        return ids, np.zeros(0, np.int64)
    ids = ids[radix_order(ids)]
    first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(axis=1)))
    return ids[first], np.diff(np.append(first, len(ids)))


def _keys(ids: np.ndarray) -> pa.Array:
    data = ids.astype(">u4").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.arange(0, 16 * len(ids) + 1, 16, dtype=np.int32)), pa.py_buffer(data)])


def _bit_of(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    return (mix64((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)) % np.uint64(size)).astype(np.int64)


def grams(seq: np.ndarray, bits: np.ndarray | None, starts: int | None = None) -> list[np.ndarray]:
    """Rows of four numbers, from the first starts on: all pairs; with bits, the three and four words in a row whose
    pairs it holds."""
    pair = (seq[:-1] != 0) & (seq[1:] != 0)
    if bits is None:
        sizes = {2: pair}
    else:
        some = np.flatnonzero(pair)
        pair[some] = held(bits, _bit_of(seq[some], seq[some + 1], 8 * len(bits)))
        three = pair[:-1] & pair[1:]
        sizes = {3: three, 4: three[:-1] & pair[2:]}
    out = []
    for n, fit in sizes.items():
        at = np.flatnonzero(fit[:starts])
        made = np.zeros((len(at), LONGEST), np.uint32)
        for k in range(n):
            made[:, k] = seq[at + k]
        out.append(made)
    return out


def counted(seqs: DataFrame, bits: np.ndarray | None, least: int) -> DataFrame:
    """key, n of the n-grams with n >= least."""
    shared = None if bits is None else seqs.sparkSession.sparkContext.broadcast(bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else shared.value
        parts: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate(parts)
            parts.clear()
            ids, n = run_lengths(ids)
            for at in range(0, len(ids), LOT):
                yield pa.RecordBatch.from_arrays([_keys(ids[at : at + LOT]), pa.array(n[at : at + LOT])], ["key", "n"])

        for batch in batches:
            for seq in batch.column("seq"):
                s = np.frombuffer(seq.as_buffer(), np.int32)
                for low in range(0, len(s), KEYS):  # a stretch shows the next one's first words
                    parts += grams(s[low : low + KEYS + LONGEST - 1], bits, KEYS)
                    if sum(map(len, parts)) >= KEYS:
                        yield from out()
                        give_back()
        if parts:
            yield from out()
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_pylist()
            halves = np.frombuffer(b"".join(key), "<u8").reshape(-1, 2)
            first = np.flatnonzero(np.append(True, (halves[1:] != halves[:-1]).any(axis=1)))
            sums = np.add.reduceat(batch.column("n").to_numpy(), first)
            if last is not None and key[0] == last:
                sums[0] += total
            elif last is not None and total >= least:
                yield _frequent([last], [total])
            last, total = key[-1], int(sums[-1])
            fit = np.flatnonzero(sums[:-1] >= least)
            yield _frequent([key[i] for i in first[fit].tolist()], sums[fit])
        if last is not None and total >= least:
            yield _frequent([last], [total])

    made = seqs.mapInArrow(pack, "key binary, n long")
    return made.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(add, "key binary, n long")


def _frequent(keys: list, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64())], ["key", "n"])


def _pair_bits(pairs: DataFrame) -> DataFrame:
    size = BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u4").reshape(-1, LONGEST)
            yield pa.RecordBatch.from_pydict({"at": pa.array(_bit_of(ids[:, 0], ids[:, 1], size))})

    return pairs.select("key").mapInArrow(run, "at long")


def _trimmed(key: str = "key") -> Column:
    """A key without the zeros of absent words; a number of a word is never zero."""
    size = F.lit(4)
    for n in range(2, LONGEST + 1):
        size = F.when(F.substring(key, 4 * n - 3, 4) != F.lit(bytes(4)), 4 * n).otherwise(size)
    return F.col(key).substr(F.lit(1), size)


def _big(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _best(rows: DataFrame, order: list[Column], ties: bool) -> DataFrame:
    """The first FIRST rows of each language, with those that tie with the last if so asked; in two steps, so no task
    gets all of a language."""
    place = F.rank() if ties else F.row_number()
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS)).alias("part")
    some = rows.select("*", part).withColumn("rank", place.over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= FIRST)
    return some.drop("part").withColumn("rank", place.over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= FIRST)


def collocations(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of every language in docs.

    Null texts are empty, and a null lang is `und`. Every row counts, repeated ones again; other columns than text and
    lang are not looked at. Ties go by a, then by phrase. A language without a phrase of `least` occurrences has no
    rows, and neither has an empty table. Long texts are read in stretches.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    every = saved(word_counts(rows))
    frequent = numbered(every.filter(F.col("n") >= least), [F.col("n").desc(), F.col("lang"), F.col("word")], "id")
    dictionary = saved(frequent.withColumn("id", F.col("id").cast("int")))
    seqs = sequences(rows, dictionary)
    pairs = saved(counted(seqs, None, least))
    longer = saved(counted(seqs, bitmap(_pair_bits(pairs)), least))
    phrases = pairs.unionByName(longer).select(_trimmed().alias("key"), F.col("n").alias("a"))
    single = dictionary.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("part"), F.col("n").alias("f"), "lang")
    parts = single.unionByName(phrases.select(F.col("key").alias("part"), F.col("a").alias("f"), F.lit(None).cast("string").alias("lang")))

    size = F.octet_length("key") / 4
    inner = F.flatten(F.transform(F.sequence(F.lit(2), (size - 1).cast("int")), lambda m: F.transform(F.sequence(F.lit(0), (size - m).cast("int")), lambda i: F.col("key").substr(i * 4 + 1, m * 4))))
    within = phrases.filter(size > 2).select("a", F.explode(inner).alias("key")).groupBy("key").agg(F.max("a").alias("most"))
    gone = F.coalesce(_big(F.col("most")) * 100 >= _big(F.col("a")) * WITHIN, F.lit(False))
    kept = phrases.join(within, "key", "left").filter(~gone).drop("most")

    cuts = F.transform(
        F.sequence(F.lit(1), (size - 1).cast("int")),
        lambda k: F.array(
            F.struct(k.alias("k"), F.lit(True).alias("left"), F.col("key").substr(F.lit(1), k * 4).alias("part")),
            F.struct(k.alias("k"), F.lit(False).alias("left"), F.col("key").substr(k * 4 + 1, F.lit(16)).alias("part")),
        ),
    )
    sides = kept.select("key", "a", F.explode(F.flatten(cuts)).alias("c")).select("key", "a", "c.*").join(parts, "part")
    of = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f")))
    made = sides.groupBy("key", "a").agg(F.max("lang").alias("lang"), *[of(k, left).alias(f"{'l' if left else 'r'}{k}") for k in range(1, LONGEST) for left in (True, False)])
    score = lambda k: F.expr(f"(cast(a as decimal(20,0)) * 2000000) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    lowest = F.array_min(F.filter(F.array(*[F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, LONGEST)]), lambda c: c["score"].isNotNull()))
    scored = made.withColumn("c", lowest).select("key", "lang", "a", "c.l", "c.r", "c.score")

    order = [F.col("score").desc(), F.col("a").desc()]
    few = saved(_best(scored, order, ties=True).drop("rank"))
    spelled = few.select("key", F.explode(F.sequence(F.lit(1), size.cast("int"))).alias("k")).withColumn("id", F.conv(F.hex(F.col("key").substr(F.col("k") * 4 - 3, F.lit(4))), 16, 10).cast("int"))
    spelled = spelled.join(dictionary.select("id", "word"), "id").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    total = every.groupBy("lang").agg(F.sum("n").alias("n"))
    best = _best(few.join(spelled, "key"), [*order, F.col("phrase")], ties=False)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
