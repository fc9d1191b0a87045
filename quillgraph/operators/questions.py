"""Questions over graphs, ten types. What chance would decide is decided by the md5 of a key, so results
do not depend on partitions. A graph has attempts() tries for each type; a try draws a candidate (the candidates
in the order of their keys, by turns), a phrasing and, where a question may have no answer, a coin. The first
tries that make whole questions, each with another wording, are taken. Only graphs whose first tries fail go on
to the rest.

Everything a question needs of its graph is in one row of context(), which only drawn candidates meet; pools of
texts of a split come in slices.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, let, norm_key
from ..sources.annotations import Graphs
from ..sources.shared import held, materialized
from .display import display_map
from .graph import domain_hints, edge_label_texts, edges_with_text, neighbours, node_texts, pool, splits, top_level
from .paths import shared_container, unique_multihop
from .rank import WHOLE, diverse, first_open, found, indexed, placed, prepared, ranked, texts_of
from .validate import UNKNOWN, keep_valid

SLICE = 50_000
LABELS = "ABCDEF"
STRINGS = "array<string>"
# The phrasings.
SAY = {
    "element_presence_mcq": [
        "Which of the following labels appears in the diagram?",
        "Which label can be found in this figure?",
        "Select the label that is present in the diagram.",
    ],
    "element_absence_mcq": [
        "Which of the following labels does NOT appear in the diagram?",
        "Select the label that is absent from this figure.",
        "Which option cannot be found in the diagram?",
    ],
    "relation_successor_hidden_abstain_mcq": [
        'According to the arrows in the diagram, which module does "{a}" directly point to?',
        'Which module is the direct target of the arrow leaving "{a}"?',
        'Looking at the diagram, which module does the arrow from "{a}" lead to?',
    ],
    "relation_successor_multiselect": [
        'According to the arrows in the diagram, which modules does "{a}" directly point to? Select all that apply.',
        'Which modules are direct targets of arrows leaving "{a}"? Select all that apply.',
        'Looking at the diagram, which modules do the arrows from "{a}" lead to? Select all that apply.',
    ],
    "relation_containment_hidden_abstain_mcq": [
        'Which module is visually enclosed within the boundary of "{a}" in the diagram?',
        'Looking at the diagram, which module is drawn inside the box labeled "{a}"?',
        'Which module appears within the visual boundary of "{a}"?',
    ],
    "relation_containment_multiselect": [
        'Which modules are visually enclosed within the boundary of "{a}" in the diagram? Select all that apply.',
        'Looking at the diagram, which modules are drawn inside the box labeled "{a}"? Select all that apply.',
        'Which modules appear within the visual boundary of "{a}"? Select all that apply.',
    ],
    "relation_edge_label_hidden_abstain_mcq": [
        'What is the label on the edge from "{a}" to "{b}"?',
        'Which text labels the relation from "{a}" to "{b}"?',
        'Select the edge label between "{a}" and "{b}".',
    ],
    "relation_multihop_top": [
        'Considering only the top-level pipeline stages, select all intermediate stages on the unique path from "{a}" to "{b}".',
        'Select all intermediate top-level stages on the unique flow path from "{a}" to "{b}".',
        'On the unique path from "{a}" to "{b}", which top-level pipeline stages appear in between? Select all that apply.',
    ],
    "relation_multihop_container": [
        'Within "{c}", select all intermediate stages on the unique flow path from "{a}" to "{b}".',
        'Inside "{c}", which main blocks appear as intermediate stages on the unique path from "{a}" to "{b}"? Select all that apply.',
    ],
    "relation_conflict_mcq": [
        "Which of the following relations is explicitly marked as conflicting?",
        "Select the relation that is annotated as a conflict.",
        "Which relation in the diagram is labeled as conflicting?",
    ],
    "function_summary_open": [
        "Briefly summarize the overall function or purpose of the diagram.",
        "What does this diagram describe at a high level?",
        "Provide a short summary of the system or process shown in the figure.",
    ],
}

#: The ten types; the registry's other names are further ways to make some of them. CHECKED are validated before
#: they are given out, the others are not.
TYPES = [
    "element_presence_mcq", "element_absence_mcq", "relation_successor_hidden_abstain_mcq", "relation_successor_multiselect", "relation_containment_hidden_abstain_mcq",
    "relation_containment_multiselect", "relation_edge_label_hidden_abstain_mcq", "relation_multihop_multiselect", "relation_conflict_mcq", "function_summary_open",
]
CHECKED = {"element_presence_mcq", "element_absence_mcq", "relation_successor_multiselect", "relation_containment_multiselect", "relation_multihop_multiselect"}


def key(seed: int, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))


def number(hashed: Column) -> Column:
    """The first eight hex digits of a key as a number."""
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long")


def context(g: Graphs, shown: DataFrame | None = None) -> DataFrame:
    """image_id, shown (ord, id, text, told, refs of the usable entities), texts, keys (of all texts), hint;
    shown is the display map, if there is one already."""
    d = display_map(g) if shown is None else shown
    one = F.struct("ord", "id", F.col("display_text").alias("text"), F.col("used_disambiguation").alias("told"), F.col("referenced_ids").alias("refs"))
    rows = d.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("usable"), one))).alias("shown"),
        F.collect_set(F.lower("raw_text")).alias("keys"),
    )
    said = F.array_sort(F.transform("shown", lambda s: F.struct(norm_key(s["text"]).alias("k"), s["text"].alias("text"))))
    first = lambda all_: F.filter(all_, lambda t, i: (i == 0) | (F.get(all_, i - 1)["k"] != t["k"]))
    rows = rows.withColumn("texts", let(said, lambda x: F.array_sort(F.transform(first(x), lambda t: t["text"]))))
    return rows.join(domain_hints(g).withColumnRenamed("domains", "hint"), "image_id")


def slices(pool: DataFrame) -> DataFrame:
    """Pools (split, key, text) as rows of texts, and an index of them (pool), with about SLICE texts each; one row for a
    small pool."""
    sizes = pool.groupBy("split").agg(F.count("*").alias("size"))  # a row for each split
    sizes = sizes.withColumn("slices", F.greatest(F.ceil(F.col("size") / SLICE), F.lit(1)).cast("int"))
    rows = pool.join(F.broadcast(sizes), "split").withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))
    texts = rows.groupBy("split", "slice", "slices", "size").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    made = texts.join(indexed(rows, "split", "slice"), ["split", "slice"], "left")
    none = F.array().cast(made.schema["pool"].dataType)
    return materialized(made.select("split", "slice", "texts", F.coalesce("pool", none).alias("pool"), "slices", "size"))


class Pools:
    """Pools as slices() gives them, and what all uses of them share."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @cached_property
    def most(self) -> tuple[int | None, int | None]:
        """Slices and texts of the largest pool."""
        return tuple(self.rows.agg(F.max("slices"), F.max("size")).first())

    @cached_property
    def counts(self) -> DataFrame:
        return materialized(self.rows.select("split", "slices").distinct())

    @cached_property
    def texts(self) -> DataFrame:
        """Of pools of one slice: all their texts."""
        pool = F.coalesce("pool", F.array().cast(self.rows.schema["pool"].dataType))
        return materialized(self.rows.select("split", texts_of(pool).alias("_all")))


def in_pool(rows: DataFrame, s: Pools, target: Column, exclude: Column, k: int | Column | None, near: bool = False) -> DataFrame:
    """rows (with image_id, attempt, hint and split) and `found`: k diverse texts of the ranking for target over all slices
    of the pool of their split; without k only the first text of it.

    Pools so small that they are ranked whole are ranked once for all rows of a target and hint; a row then only passes
    over the texts that it excludes.
    """
    one = k is None
    take = (lambda x: F.get(x, F.lit(0))["text"]) if one else (lambda x: diverse(x, k))
    enough = F.isnotnull if one else (lambda got: F.size(got) >= k)
    find = lambda pool: found(target, pool, F.col("hint"), exclude, near, one)
    none = F.array().cast("array<struct<s:double,text:string,first:string,last:string>>")
    most, largest = s.most
    if most is None:
        return rows.withColumn("found", take(none))
    if largest <= WHOLE:
        pools = s.texts
        rows = rows.withColumn("_target", target)
        once = rows.select("split", "_target", "hint").distinct().join(F.broadcast(pools), "split")
        once = materialized(once.select("split", "_target", "hint", placed(F.col("_target"), F.col("_all"), F.col("hint"), near).alias("_places")))
        rows = rows.join(once, ["split", "_target", "hint"], "left")
        few = pools.select("split", F.transform("_all", lambda c: F.struct(*[c[k].alias(k) for k in ("key", "text", "first", "last")])).alias("_all"))
        rows = rows.join(F.broadcast(few), "split", "left")
        places = F.coalesce("_places", F.array().cast("array<int>"))
        return held(rows, found=first_open(places, F.col("_all"), exclude, take, enough)).drop("_target", "_places", "_all")
    if most == 1:
        pool = F.coalesce("pool", F.array().cast(s.rows.schema["pool"].dataType))
        return materialized(rows.join(s.rows.select("split", "pool"), "split", "left").withColumn("found", take(find(pool))).drop("pool"))
    dealt = rows.join(F.broadcast(s.counts), "split").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.join(s.rows.select("split", "slice", "pool"), ["split", "slice"]).withColumn("found", find(F.col("pool")))
    dealt = materialized(dealt.select("image_id", "attempt", "found"))
    merged = dealt.groupBy("image_id", "attempt").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    return rows.join(merged, ["image_id", "attempt"], "left").withColumn("found", take(F.coalesce("found", none)))


def attempts(limit: int) -> int:
    """Tries of a graph for `limit` questions."""
    return max(8, 6 * limit)


def drawn(rows: DataFrame, seed: int, qtype: str, *parts: str) -> DataFrame:
    """Candidates of each graph with their place by key, from 0, and their number."""
    image = Window.partitionBy("image_id")
    place = F.row_number().over(image.orderBy(key(seed, qtype, F.col("image_id"), *map(F.col, parts)), *parts))
    return rows.withColumns({"place": place - 1, "candidates": F.count("*").over(image)})


def tries(candidates: Column, low: int, high: int, again: bool = True) -> Column:
    """drawn() and at_tries() of one graph: array<struct<attempt, c>> of the tries from low up to but without high; candidates
    are structs that begin with their key and its parts."""
    if (low, high) == (0, 1):  # the first of them is the least
        return F.transform(F.filter(F.array(F.array_min(candidates)), lambda c: c.isNotNull()), lambda c: F.struct(F.lit(0).alias("attempt"), c.alias("c")))
    fit = lambda order: F.filter(
        F.sequence(F.lit(low), F.lit(high - 1)), lambda a: (F.size(order) > 0) & (F.lit(again) | (a < F.size(order))),
    )
    return let(F.array_sort(candidates), lambda x: F.transform(fit(x), lambda a: F.struct(a.alias("attempt"), F.get(x, a % F.size(x)).alias("c"))))


def at_tries(rows: DataFrame, low: int, high: int, again: bool = True) -> DataFrame:
    """Drawn candidates by the tries (attempt, from low up to but without high) that they are taken at, by turns;
    once each where another turn cannot come out otherwise (again is false)."""
    turns = F.filter(
        F.sequence(F.lit(low), F.lit(high - 1)),
        lambda a: (a % F.col("candidates") == F.col("place")) & (F.lit(again) | (a < F.col("candidates"))),
    )
    return rows.filter(F.col("place") < high).withColumn("attempt", F.explode(turns)).drop("place", "candidates")


def _option_list(seed: int, qtype: str, correct: Column, wrong: Column) -> Column:
    """Options in the order of their keys, with labels."""
    order = F.array_sort(
        F.transform(F.concat(correct, wrong), lambda t: F.struct(key(seed, qtype, F.col("image_id"), "option", t).alias("k"), t.alias("text")))
    )
    return F.transform(order, lambda o, i: F.struct(F.substring(F.lit(LABELS), i + 1, F.lit(1)).alias("label"), o["text"].alias("text")))


def _said(seed: int, qtype: str, phrasings: list[str]) -> Column:
    """The phrasing of a try."""
    pick = F.pmod(number(key(seed, qtype, F.col("image_id"), F.col("attempt"), "phrase")), F.lit(len(phrasings))).cast("int")
    return F.element_at(F.array(*map(F.lit, phrasings)), pick + 1)


def assemble(rows: DataFrame, seed: int, qtype: str, level: str, phrasing: str | None = None, multi: Column | bool = False) -> DataFrame:
    """Questions, with their attempt, from rows (image_id, paper_id, attempt, correct, wrong, a, b, c, metadata);
    options that are too few or not distinct drop a row."""
    multi = F.lit(multi) if isinstance(multi, bool) else multi
    needed = [c for c in ("image_id", "paper_id", "attempt", "correct", "wrong", "a", "b", "c", "metadata") if c in rows.columns]
    rows = held(rows.select(*needed, multi.alias("multi")), options=_option_list(seed, qtype, F.col("correct"), F.col("wrong")))
    keys = F.array_distinct(F.transform("options", lambda o: norm_key(o["text"])))
    n, distinct = F.size("options"), F.size(keys) == F.size("options")
    rows = rows.filter(distinct & F.when(F.col("multi"), (n >= 4) & (F.size("correct") >= 2)).otherwise((n == 4) & (F.size("correct") <= 1)))
    text = _said(seed, qtype, SAY[phrasing or qtype])
    for name in ("a", "b", "c"):
        if name in rows.columns:
            text = F.replace(text, F.lit("{%s}" % name), F.coalesce(F.col(name), F.lit("")))
    right = F.filter(F.transform("options", lambda o, i: F.when(F.array_contains("correct", o["text"]), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("correct_option_indices", right)
    none = F.size("correct") == 0
    picked = lambda field: F.when(none, F.array(F.lit(UNKNOWN))).otherwise(
        F.transform("correct_option_indices", lambda i: F.get("options", i)[field])
    )
    return rows.select(
        "image_id", "paper_id", "attempt", F.lit(level).alias("level"), F.lit(qtype).alias("question_type"), text.alias("question"), "options", picked("label").alias("answer"), picked("text").alias("answer_text"),
        "correct_option_indices", F.when(F.col("multi"), "multi_select").otherwise("single_choice").alias("answer_type"), F.col("metadata").cast("map<string,string>").alias("metadata"),
    )


def _meta(**values: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())


def _keys(*texts: Column) -> Column:
    return F.array(*[norm_key(t) for t in texts])


NOTHING = "map<string,string>"


class Kept:
    """Graph tables that are made once, each when it is first asked for."""

    def __init__(self, g: Graphs):
        self._g = g

    @cached_property
    def graphs(self) -> DataFrame:
        return materialized(self._g.graphs)

    @cached_property
    def entities(self) -> DataFrame:
        return materialized(self._g.entities)

    @cached_property
    def relations(self) -> DataFrame:
        return materialized(self._g.relations)


class Generator:
    """All types over all graphs at once. parts (image_id, split) names the split of each graph, one for all if there is
    none; a split has pools of its own, which hold the texts of its graphs only."""

    def __init__(self, g: Graphs, seed: int = 42, unanswerable: float = 0.5, limit: int = 1, parts: DataFrame | None = None):
        self.g = Kept(g)
        self.seed, self.limit, self._several, self._linked = seed, limit, False, {}
        self.unanswerable = min(1.0, max(0.0, unanswerable))
        self._split = (lambda x: x.join(parts, "image_id")) if parts is not None else (lambda x: x.withColumn("split", F.lit("all")))

    # A type makes what it needs; the tables are shared by the types after it.
    @cached_property
    def display(self) -> DataFrame:
        return materialized(display_map(self.g))

    @cached_property
    def context(self) -> DataFrame:
        """A row for each graph; where several types use them, its texts are made candidates (ready) once."""
        rows = self._split(context(self.g, self.display).join(self.g.graphs, "image_id"))
        return materialized(rows.withColumn("ready", prepared(F.col("texts"))) if self._several else rows)

    @cached_property
    def nodes(self) -> Pools:
        return Pools(slices(materialized(pool(self._split(node_texts(self.g)), "split"))))

    @cached_property
    def labels(self) -> Pools:
        return Pools(slices(materialized(pool(self._split(edge_label_texts(self.g)), "split"))))

    def links(self, predicate: str) -> DataFrame:
        """image_id, links: the edges of each graph (ord, id, neighbour)."""
        if predicate not in self._linked:
            one = F.struct(F.col("ord").cast("long").alias("ord"), "id", "neighbour")
            rows = neighbours(self.g, predicate).groupBy("image_id").agg(F.array_sort(F.collect_list(one)).alias("links"))
            self._linked[predicate] = materialized(rows)
        return self._linked[predicate]

    def _entity(self, q: str, low: int, high: int) -> Column:
        """An entity of a row of context for each try, by turns."""
        own = F.transform("shown", lambda s: F.struct(key(self.seed, q, F.col("image_id"), s["id"]).alias("k"), s["id"].alias("id"), s.alias("s")))
        return tries(own, low, high, self.limit > 1)

    def _drawn(self, rows: DataFrame, by_try: Column, *columns: str, **of: str) -> DataFrame:
        """What questions need of rows of context, for each try that by_try has: columns of the row, and of what is drawn."""
        rows = rows.select("image_id", "paper_id", "hint", "split", *columns, F.explode(by_try).alias("_t"))
        return rows.select(*[c for c in rows.columns if c != "_t"], "_t.attempt", *[F.col(f"_t.c.{v}").alias(k) for k, v in of.items()])

    def _ready(self, rows: DataFrame) -> DataFrame:
        """rows of context with their texts as candidates."""
        return rows if self._several else rows.withColumn("ready", prepared(F.col("texts")))

    @property
    def _own(self) -> str:
        """The column that _ready() needs."""
        return "ready" if self._several else "texts"

    def _tried(self, make: Callable[[int, int], DataFrame], qtype: str) -> DataFrame:
        """The first whole questions of each graph: make(low, high) gives those of some tries.

        All graphs have their first tries; the ones that still want questions have the rest.
        """
        make_ = (lambda a, b: keep_valid(make(a, b), self.context)) if qtype in CHECKED else make
        once = Window.partitionBy("image_id", norm_key(F.col("question"))).orderBy("attempt")
        nth = Window.partitionBy("image_id").orderBy("attempt")

        def taken(rows: DataFrame) -> DataFrame:
            rows = rows.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
            return rows.withColumn("_n", F.row_number().over(nth)).filter(F.col("_n") <= self.limit).drop("_n")

        first = make_(0, self.limit)
        first = materialized(first if self.limit == 1 else taken(first))  # one try of a graph is one question at most
        full = first.groupBy("image_id").agg(F.count("*").alias("n")).filter(F.col("n") >= self.limit)
        self._open = self.g.graphs.select("image_id").join(full, "image_id", "left_anti")
        more = materialized(make_(self.limit, attempts(self.limit)))
        if self.limit == 1:  # a graph has its question in one of them
            return first.unionByName(taken(more)).drop("attempt")
        # kept once more: a union of two kept tables claims their buckets, but its tasks are those of both, one after the other
        return taken(materialized(first.unionByName(more))).drop("attempt")

    def _wanting(self, rows: DataFrame, low: int) -> DataFrame:
        """rows of the graphs that are still open."""
        return rows.join(self._open, "image_id", "left_semi") if low else rows

    def _coin(self, qtype: str, attempt: Column) -> Column:
        """Whether a try is for an answerable question."""
        cut = f"{min(int(self.unanswerable * (1 << 32)), (1 << 32) - 1):08x}"
        coin = F.substring(key(self.seed, qtype, F.col("image_id"), attempt, "coin"), 1, 8) > cut
        return coin if self.unanswerable < 1 else F.lit(False)

    def _or_unanswerable(
        self, qtype: str, yes: Callable[[DataFrame, int, int], DataFrame], no: Callable[[DataFrame, int, int], DataFrame],
    ) -> DataFrame:
        """A try makes an answerable question where its coin says so and there is one, else an unanswerable one. yes and no
        make rows of tries of some rows of context."""

        def make(low: int, high: int) -> DataFrame:
            own = self._wanting(self.context, low)
            some = own.filter(F.exists(F.sequence(F.lit(low), F.lit(high - 1)), lambda a: self._coin(qtype, a)))
            made = yes(some, low, high).filter(self._coin(qtype, F.col("attempt")))
            made = materialized(assemble(made, self.seed, qtype, "L2"))
            if high - low == 1:
                rest = no(own.join(made.select("image_id"), "image_id", "left_anti"), low, high)
            else:
                rest = no(own, low, high).join(made.select("image_id", "attempt"), ["image_id", "attempt"], "left_anti")
            return made.unionByName(assemble(rest, self.seed, qtype, "L2"))

        return self._tried(make, qtype)

    def presence(self) -> DataFrame:
        q = "element_presence_mcq"

        def make(low: int, high: int) -> DataFrame:
            rows = self._drawn(self._wanting(self.context, low), self._entity(q, low, high), "keys", text="s.text", told="s.told")
            rows = in_pool(rows, self.nodes, F.col("text"), F.concat("keys", _keys(F.col("text"))), 3, near=True)
            return assemble(
                rows.withColumns({"correct": F.array("text"), "wrong": F.col("found"), "metadata": _meta(used_disambiguation=F.col("told"))}),
                self.seed, q, "L1",
            )

        return self._tried(make, q)

    def absence(self) -> DataFrame:
        q = "element_absence_mcq"

        def make(low: int, high: int) -> DataFrame:
            rows = self._wanting(self.context, low).filter(F.size("texts") >= 3)
            rows = self._drawn(rows, self._entity(q, low, high), "keys", self._own, text="s.text")
            rows = in_pool(rows, self.nodes, F.col("text"), F.concat("keys", _keys(F.col("text"))), None)
            rows = self._ready(rows.withColumnRenamed("found", "best").filter("best is not null"))
            wrong = diverse(ranked(F.col("best"), F.col("ready"), F.col("hint"), _keys(F.col("best")), near=True), 3)
            return assemble(rows.withColumns({"correct": F.array("best"), "wrong": wrong, "metadata": F.create_map().cast(NOTHING)}), self.seed, q, "L1")

        return self._tried(make, q)

    def _other_nodes(self, target: Column, k: int | Column, exclude: Column) -> Column:
        return diverse(ranked(target, F.col("ready"), F.col("hint"), exclude), k)

    def _abstain(self, q: str, predicate: str, reason: str) -> DataFrame:
        """A unique successor or container child; or an entity without any usable one."""
        forward = predicate == "flows_to"
        a, b = ("id", "neighbour") if forward else ("neighbour", "id")
        source, target = (F.col("text"), F.col("other_text")) if forward else (F.col("other_text"), F.col("text"))
        of = lambda id_: F.filter("shown", lambda s: s["id"] == id_)
        by_key = lambda s: key(self.seed, q, F.col("image_id"), s["id"]).alias("k")
        large = lambda rows: rows.filter(F.size("texts") >= 4)

        def yes(rows: DataFrame, low: int, high: int) -> DataFrame:
            rows = large(rows).join(self.links(predicate), "image_id").withColumn("ids", F.transform("links", lambda e: e[a]))
            alone = lambda e: F.array_position("ids", e[a]) + F.array_position(F.reverse("ids"), e[a]) == F.size("ids") + 1
            both = lambda e: F.flatten(F.transform(of(e[a]), lambda s: F.transform(of(e[b]), lambda o: F.struct(by_key(s), s["id"].alias("id"), s.alias("s"), o.alias("o")))))
            drawn_ = tries(F.flatten(F.transform(F.filter("links", alone), both)), low, high)
            rows = self._ready(self._drawn(rows, drawn_, self._own, text="s.text", told="s.told", other_text="o.text", other_told="o.told"))
            meta = _meta(is_unanswerable=F.lit(False), used_disambiguation=F.col("told") | F.col("other_told"))
            return rows.withColumns({"a": source, "correct": F.array(target), "wrong": self._other_nodes(target, 3, _keys(source, target)), "metadata": meta})

        def no(rows: DataFrame, low: int, high: int) -> DataFrame:
            none = F.array().cast(self.links(predicate).schema["links"].dataType)
            rows = large(rows).join(self.links(predicate), "image_id", "left").withColumn("ids", F.transform("shown", lambda s: s["id"]))
            busy = F.transform(F.filter(F.coalesce("links", none), lambda e: F.array_contains("ids", e["neighbour"])), lambda e: e["id"])
            rows = rows.withColumn("busy", busy)
            own = F.transform(F.filter("shown", lambda s: ~F.array_contains("busy", s["id"])), lambda s: F.struct(by_key(s), s["id"].alias("id"), s.alias("s")))
            rows = self._ready(self._drawn(rows, tries(own, low, high), self._own, text="s.text", told="s.told"))
            meta = _meta(is_unanswerable=F.lit(True), unanswerable_reason=F.lit(reason), used_disambiguation=F.col("told"))
            wrong = self._other_nodes(F.col("text"), 4, _keys(F.col("text")))
            return rows.withColumns({"a": F.col("text"), "correct": F.array().cast(STRINGS), "wrong": wrong, "metadata": meta})

        return self._or_unanswerable(q, yes, no)

    def successor_abstain(self) -> DataFrame:
        return self._abstain("relation_successor_hidden_abstain_mcq", "flows_to", "no_usable_successor")

    def containment_abstain(self) -> DataFrame:
        return self._abstain("relation_containment_hidden_abstain_mcq", "contains", "no_usable_child")

    def _multi(self, q: str, predicate: str, names: tuple[str, str, str]) -> DataFrame:
        """Entities with two usable neighbours at least; four of them are asked for at most."""

        def make(low: int, high: int) -> DataFrame:
            rows = self._wanting(self.context, low).filter(F.size("texts") >= 5).join(self.links(predicate), "image_id")
            rows = rows.withColumn("ids", F.transform("links", lambda e: e["id"]))
            again = lambda s: F.array_position("ids", s["id"]) + F.array_position(F.reverse("ids"), s["id"]) < F.size("ids") + 1
            to = lambda e: F.transform(F.filter("shown", lambda o: o["id"] == e["neighbour"]), lambda o: F.struct(e["ord"].alias("ord"), o["text"].alias("text")))
            all_ = lambda s: F.array_sort(F.flatten(F.transform(F.filter("links", lambda e: e["id"] == s["id"]), to)))["text"]
            one = lambda s: F.struct(key(self.seed, q, F.col("image_id"), s["id"]).alias("k"), s["id"].alias("id"), s.alias("s"), all_(s).alias("all"))
            own = F.filter(F.transform(F.filter("shown", lambda s: F.array_contains("ids", s["id"]) & again(s)), one), lambda x: F.size(x["all"]) >= 2)
            rows = self._drawn(rows, tries(own, low, high, self.limit > 1), self._own, id="id", text="s.text", told="s.told", all="all")
            rows = self._ready(rows.withColumn("all", F.array_distinct("all")))
            wrong = self._other_nodes(
                F.get("all", F.lit(0)), F.greatest(F.lit(1), 4 - F.size("all")),
                F.concat(_keys(F.col("text")), F.transform("all", norm_key)),
            )
            rows = rows.withColumn("correct", F.slice("all", 1, 4))
            room = F.least(F.lit(6), F.greatest(F.lit(4), F.size("correct") + 2)) - F.size("correct")
            meta = _meta(**{"used_disambiguation": F.col("told"), names[0]: F.col("id"), names[1]: F.col("text"), names[2]: F.size("correct")})
            return assemble(rows.withColumns({"wrong": F.slice(wrong, F.lit(1), room), "a": F.col("text"), "metadata": meta}), self.seed, q, "L2", multi=True)

        return self._tried(make, q)

    def successor_multi(self) -> DataFrame:
        return self._multi("relation_successor_multiselect", "flows_to", ("src_id", "src_display", "successor_count"))

    def containment_multi(self) -> DataFrame:
        return self._multi("relation_containment_multiselect", "contains", ("container_id", "container_display", "child_count"))

    def edge_label(self) -> DataFrame:
        """Of graphs with a labelled edge: the label of an edge, or of a pair that has none; four labels at least are in the pool."""
        q = "relation_edge_label_hidden_abstain_mcq"
        one = F.struct(F.col("ord").cast("long").alias("ord"), F.col("subject_id").alias("a"), F.col("object_id").alias("b"), clean(F.col("edge_text")).alias("label"))
        named = materialized(edges_with_text(self.g).groupBy("image_id").agg(F.collect_list(one).alias("named")))
        enough = self.labels.rows.filter("size >= 4").select("split", "slices").distinct()
        fit = lambda rows: rows.join(F.broadcast(enough.select("split")), "split", "left_semi").join(named, "image_id")
        told, columns = F.col("a_told") | F.col("b_told"), {"a": "x.text", "a_told": "x.told", "b": "y.text", "b_told": "y.told"}
        own = lambda *parts: key(self.seed, q, F.col("image_id"), *parts).alias("k")

        def yes(rows: DataFrame, low: int, high: int) -> DataFrame:
            of = lambda id_: F.filter("shown", lambda s: s["id"] == id_)
            both = lambda e: F.flatten(F.transform(of(e["a"]), lambda x: F.transform(of(e["b"]), lambda y: F.struct(own(e["ord"]), e["ord"].alias("ord"), e["label"].alias("label"), x.alias("x"), y.alias("y")))))
            rows = self._drawn(fit(rows), tries(F.flatten(F.transform("named", both)), low, high), label="label", **columns)
            rows = in_pool(rows, self.labels, F.col("label"), _keys(F.col("label")), 3)
            return rows.withColumns(
                {"correct": F.array("label"), "wrong": F.col("found"), "metadata": _meta(is_unanswerable=F.lit(False), used_disambiguation=told)}
            )

        def no(rows: DataFrame, low: int, high: int) -> DataFrame:
            # any ordered pair without a label between them; the pairs of a graph come from its own row
            shut = lambda x: F.array_append(F.transform(F.filter("named", lambda e: e["a"] == x["id"]), lambda e: e["b"]), x["id"])
            pair = lambda x, y: F.struct(own(x["id"], y["id"]), x["id"].alias("a_id"), y["id"].alias("b_id"), x.alias("x"), y.alias("y"))
            others = lambda x: let(shut(x), lambda s: F.transform(F.filter("shown", lambda y: ~F.array_contains(s, y["id"])), lambda y: pair(x, y)))
            rows = self._drawn(fit(rows), tries(F.flatten(F.transform("shown", others)), low, high), **columns)
            # a label to rank by is drawn for each try
            luck = number(key(self.seed, q, F.col("image_id"), F.col("attempt"), "like"))
            rows = rows.join(F.broadcast(enough), "split").withColumn("slice", F.pmod(luck, F.col("slices")).cast("int"))
            rows = rows.join(self.labels.rows.select("split", "slice", "texts"), ["split", "slice"]).drop("slice", "slices")
            rows = rows.withColumn("like", F.get("texts", F.pmod(luck, F.size("texts")).cast("int"))).drop("texts")
            rows = in_pool(rows, self.labels, F.col("like"), _keys(F.col("like")), 4)
            meta = _meta(is_unanswerable=F.lit(True), unanswerable_reason=F.lit("no_edge_label"), used_disambiguation=told)
            return rows.withColumns({"correct": F.array().cast(STRINGS), "wrong": F.col("found"), "metadata": meta})

        return self._or_unanswerable(q, yes, no)

    def multihop(self) -> DataFrame:
        """Longest unique paths first, at top level before within containers; a path in several containers is of
        the least one."""
        q = "relation_multihop_multiselect"
        usable = self.display.filter("usable").select("image_id", "id")
        top = top_level(self.g).join(usable, ["image_id", "id"], "left_semi").select("image_id", F.lit("").alias("scope"), "id")
        inside = neighbours(self.g, "contains", forward=False).join(usable, ["image_id", "id"], "left_semi").select("image_id", F.col("neighbour").alias("scope"), "id").distinct()
        scopes = materialized(top.unionByName(inside))
        paths = materialized(unique_multihop(self.g, scopes))
        boxed = shared_container(self.g, paths.filter("scope <> ''")).withColumnRenamed("container", "scope")
        paths = paths.filter("scope = ''").unionByName(paths.filter("scope <> ''").join(boxed, ["image_id", "path", "scope"], "left_semi"))
        members = scopes.groupBy("image_id", "scope").agg(F.collect_set("id").alias("members"))
        rows = paths.join(members, ["image_id", "scope"]).join(self.context.select("image_id", "paper_id", "hint", "split", "shown", "keys"), "image_id")
        rows = rows.withColumn("of", F.map_from_entries(F.transform("shown", lambda s: F.struct(s["id"], s))))
        shown = lambda i: F.try_element_at("of", i)
        rows = rows.withColumns(
            {"src_": shown(F.col("src")), "tgt_": shown(F.col("tgt")), "middle": F.slice("path", F.lit(2), F.size("path") - 2)}
        ).filter("src_ is not null and tgt_ is not null")
        rows = rows.withColumn("mid", F.transform("middle", shown)).withColumn("between", F.transform("mid", lambda s: s["text"])).filter(F.forall("between", lambda t: t.isNotNull()))
        ends = F.concat_ws("\n", norm_key(F.col("src_.text")), norm_key(F.col("tgt_.text")))
        rows = rows.filter(
            ~F.arrays_overlap(F.concat("src_.refs", "tgt_.refs"), F.col("middle")) & ~F.exists("between", lambda t: F.contains(ends, norm_key(t)))
        )
        rows = rows.withColumn("box", shown(F.col("scope"))).filter("scope = '' or box is not null")
        order = Window.partitionBy("image_id").orderBy(F.col("scope") != "", F.desc("hops"), key(self.seed, q, F.col("image_id"), F.col("scope")), "src", "tgt")
        paths = materialized(rows.withColumn("attempt", F.row_number().over(order) - 1).drop("of"))  # all paths are tried here

        def make(low: int, high: int) -> DataFrame:
            rows = self._wanting(paths, low).filter(F.col("attempt") >= low)
            rows = rows.filter(F.col("attempt") < high) if not low else rows
            rows = self._ready(rows.join(self.context.select("image_id", self._own), "image_id"))
            least = F.greatest(F.lit(1), 4 - F.size("between"))
            like, shut = F.get("between", F.lit(0)), F.transform(F.array_union("between", F.array("src_.text", "tgt_.text")), norm_key)
            of = lambda texts: F.filter("ready", lambda r: F.array_contains(texts, r["text"]))
            near = F.transform(F.filter("shown", lambda s: F.array_contains("members", s["id"]) & ~F.array_contains("path", s["id"])), lambda s: s["text"])
            rows = rows.withColumn("picked", diverse(ranked(like, of(near), F.col("hint"), shut, near=True), least))
            wide = F.transform(F.filter("shown", lambda s: ~F.array_contains("path", s["id"])), lambda s: s["text"])
            rows = rows.withColumn(
                "picked",
                F.concat(
                    "picked",
                    diverse(ranked(like, of(wide), F.col("hint"), F.concat(shut, F.transform("picked", norm_key)), near=True), least - F.size("picked")),
                ),
            )
            rows = in_pool(
                rows.drop("ready", self._own, "shown", "members"), self.nodes, like,
                F.concat(shut, F.col("keys"), F.transform("picked", norm_key)), least - F.size("picked"), near=True,
            )
            wrong = F.concat("picked", "found")
            room = F.least(F.lit(6), F.greatest(F.lit(4), F.size("between") + 2)) - F.size("between")
            told = F.col("src_.told") | F.col("tgt_.told") | F.exists("mid", lambda s: s["told"])
            meta = _meta(
                used_disambiguation=told, path_scope=F.when(F.col("scope") == "", "top_level_only").otherwise("local_container"), path_unique=F.lit(True), src_id=F.col("src"), src_display=F.col("src_.text"),
                tgt_id=F.col("tgt"), tgt_display=F.col("tgt_.text"), path_node_ids=F.to_json("path"), intermediate_node_ids=F.to_json("middle"), intermediate_displays=F.to_json("between"), scope_container=F.col("box.text"), scope_container_id=F.nullif("scope", F.lit("")),
            )
            rows = rows.withColumns(
                {
                    "correct": F.col("between"), "wrong": F.slice(wrong, F.lit(1), room), "a": F.col("src_.text"),
                    "b": F.col("tgt_.text"), "c": F.col("box.text"), "metadata": meta,
                }
            )
            multi = F.size("correct") > 1
            made = [assemble(rows.filter(f"scope {op} ''"), self.seed, q, "L2", f"relation_multihop_{name}", multi) for op, name in (("=", "top"), ("<>", "container"))]
            return made[0].unionByName(made[1])

        return self._tried(make, q)

    def conflict(self) -> DataFrame:
        q = "relation_conflict_mcq"
        usable = self.display.filter("usable")
        ends = lambda side: usable.select("image_id", F.col("id").alias(f"{side}_id"), F.col("display_text").alias(side))
        said = self.g.relations.join(ends("subject"), ["image_id", "subject_id"]).join(ends("object"), ["image_id", "object_id"])
        said = said.select("image_id", "ord", F.concat_ws(" ", "subject", "predicate", "object").alias("text"), "is_conflict")
        said = said.groupBy("image_id", norm_key(F.col("text")).alias("k")).agg(
            F.min_by("text", "ord").alias("text"), F.bool_or("is_conflict").alias("is_conflict"),
        )
        all_ = materialized(said.groupBy("image_id").agg(F.array_sort(F.collect_list("text")).alias("all")))
        cast = materialized(drawn(said.filter("is_conflict").select("image_id", "text"), self.seed, q, "text"))

        def make(low: int, high: int) -> DataFrame:
            rows = at_tries(self._wanting(cast, low), low, high, self.limit > 1).join(all_, "image_id").join(self.g.graphs, "image_id")
            others = F.array_sort(
                F.transform(
                    F.filter("all", lambda t: t != F.col("text")),
                    lambda t: F.struct(key(self.seed, q, F.col("image_id"), F.col("attempt"), t).alias("k"), t.alias("text")),
                )
            )
            return assemble(
                rows.withColumns({"correct": F.array("text"), "wrong": F.slice(others["text"], 1, 3), "metadata": F.create_map().cast(NOTHING)}),
                self.seed, q, "L3",
            )

        return self._tried(make, q)

    def summary(self) -> DataFrame:
        q = "function_summary_open"
        empty = F.array().cast("array<struct<label:string,text:string>>")
        cast = self.g.graphs.filter("summary_text <> ''")

        def make(low: int, high: int) -> DataFrame:
            rows = self._wanting(cast, low).withColumn("attempt", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
            return rows.select(
                "image_id", "paper_id", "attempt", F.lit("L3").alias("level"), F.lit(q).alias("question_type"), _said(self.seed, q, SAY[q]).alias("question"), empty.alias("options"), F.array("summary_text").alias("answer"),
                F.array("summary_text").alias("answer_text"), F.lit(None).cast("array<int>").alias("correct_option_indices"), F.lit("open").alias("answer_type"), F.create_map().cast(NOTHING).alias("metadata"),
            )

        return self._tried(make, q)

    def registry(self) -> dict[str, Callable[[], DataFrame]]:
        """All names; a forced unanswerable type is the same with a ratio of 1."""

        def sure(name: str) -> DataFrame:
            ratio, self.unanswerable = self.unanswerable, 1.0
            try:
                return getattr(self, name)()
            finally:
                self.unanswerable = ratio

        abstain = {"successor": "successor_abstain", "containment": "containment_abstain", "edge_label": "edge_label"}
        return {
            "element_presence_mcq": self.presence, "element_absence_mcq": self.absence, "relation_successor_hidden_abstain_mcq": self.successor_abstain, "relation_successor_multiselect": self.successor_multi,
            "relation_containment_hidden_abstain_mcq": self.containment_abstain, "relation_containment_multiselect": self.containment_multi, "relation_edge_label_hidden_abstain_mcq": self.edge_label,
            "relation_multihop_multiselect": self.multihop, "relation_conflict_mcq": self.conflict, "function_summary_open": self.summary,
            **{f"relation_{k}_mcq": getattr(self, v) for k, v in abstain.items()}, **{f"relation_unanswerable_{k}_mcq": lambda v=v: sure(v) for k, v in abstain.items()},
        }

    def generate(self, types: list[str] | None = None) -> DataFrame:
        """Questions of all types that are known (none named: of all names); others are skipped."""
        known = self.registry()
        wanted = [t for t in (types or known) if t in known]
        self._several = len(wanted) > 1
        made = [known[t]() for t in wanted]
        if not made:
            raise ValueError(f"no known question type in {types}")
        return reduce(DataFrame.unionByName, made)


def dataset(
    g: Graphs, types: list[str] | None = None, split: tuple[float, float, float] | None = (0.8, 0.1, 0.1), seed: int = 42,
    unanswerable: float = 0.5, limit: int = 1,
) -> DataFrame:
    """The questions of all graphs with their split; without ratios all are of one split, `all`.

    One generator makes those of all splits; pools are joined by split, so no option of one split is taken from the
    texts of another.
    """
    types = types or [t for t in TYPES if t != "relation_conflict_mcq"]
    if split is None:
        return Generator(g, seed, unanswerable, limit).generate(types).withColumn("split", F.lit("all"))
    parts = materialized(splits(g, *split, seed))
    return Generator(g, seed, unanswerable, limit, parts).generate(types).join(parts, "image_id")


def summarize(questions: DataFrame) -> DataFrame:
    """Counts by level, type and answer type, and overall with the number of distinct graphs."""
    rows = questions.select("image_id", *[F.coalesce(c, F.lit("UNKNOWN")).alias(c) for c in ("level", "question_type", "answer_type")])
    sets = rows.groupingSets([["level"], ["question_type"], ["answer_type"], []], "level", "question_type", "answer_type")
    return sets.agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("graphs"))


def summary_lines(counts: DataFrame) -> DataFrame:
    """group, name, n of summarize() in the order in which a report prints them."""
    kinds = ("level", "question_type", "answer_type")
    group = F.coalesce(*[F.when(F.col(k).isNotNull(), k) for k in kinds], F.lit("all"))
    return counts.select(group.alias("group"), F.coalesce(*kinds, F.lit("")).alias("name"), "n").orderBy("group", "name")
