"""N-gram Jaccard join with a MinHash LSH forest.

Texts are sets of five-word shingles; two are linked if the Jaccard similarity
of their sets is 0.8 or more. Texts with equal sets are one class, which is
compared once, by its member with the least doc_id.

The forest has ``TREES`` prefix tries. A class hangs in each of them under
``DEPTHS[0]`` MinHash values; the classes below a node share the prefix that
leads to it. A pair belongs to its deepest common node, of several to that of
the first tree, and is verified exactly, there alone. Nodes are first taken at
the full length. Prefixes are then shortened step by step until a pair just
at the threshold has a common node with chance ``target``,
1 - (1 - similarity**depth)**TREES, and only where that can bring new pairs: a
node with the same classes as a deeper one, or as one of an earlier tree, is
passed over, and of a larger node only those classes go on that have a partner
not met at a longer prefix or in an earlier tree. So copies are settled at long
prefixes, where texts that share no more than a notice do not meet, and a
shorter prefix costs little. What is found does not depend on other texts.

Nodes of any size are cut into blocks, each pair of blocks is a group of its
own, and links are counted there, not emitted. Only spanning forests of the
links leave a block; they are joined to groups by rounds of star contraction.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A text of one to four words is one
shingle. Shingles are 64-bit hashes.

Defined cases: a null, empty or wordless text is linked to nothing: its
class_id and group_id are its own doc_id, n_links 0. Rows that repeat are
copies of each other, each counted. A null doc_id is as good as any other; a
class or group takes the least doc_id that is not null. An empty table gives
no rows. Texts are read whole, other columns are not looked at. Ids never leave
the JVM, so they may have any size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import ascii_words, free_name, hash_words, mix, text_udf, window_hashes
from panelmark.session import cut

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTHS = 16, (4, 3)
TARGET = 0.9999
#: classes in a block; a task holds two
BLOCK = 1024
#: nodes of more classes are thinned before their shingles are moved
SMALL = 8
_SEEDS = mix(np.arange(1, TREES * DEPTHS[0] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MARK, _CLASS = "fp binary, labels binary", "fp binary"


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    words = ascii_words(text) if text else []
    return np.unique(window_hashes(hash_words(words), min(width, len(words)))) if words else np.empty(0, np.uint64)


def fingerprint(marks: np.ndarray) -> bytes:
    """128 bits of a set of shingles."""
    with np.errstate(over="ignore"):
        a = mix(marks).sum(dtype=np.uint64)
        b = mix(marks ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()


def labels(marks: np.ndarray) -> np.ndarray:
    """TREES x DEPTHS[0] MinHash values of 32 bits."""
    out = np.empty(len(_SEEDS), np.uint64)
    high = mix(marks)
    room = np.empty_like(high)
    with np.errstate(over="ignore"):
        for i, seed in enumerate(_SEEDS):
            # xor and multiply: the odd multiplier makes each seed an order of its own
            np.bitwise_xor(high, seed, out=room)
            np.multiply(room, seed | np.uint64(1), out=room)
            out[i] = room.min()
    return (mix(out) >> np.uint64(32)).astype(np.uint32).reshape(TREES, DEPTHS[0])


def nodes(values: np.ndarray, depth: int) -> np.ndarray:
    """The node at ``depth`` of each tree, for labels [..., TREES, DEPTHS[0]]."""
    at = np.zeros(values.shape[:-1], np.uint64)
    with np.errstate(over="ignore"):
        for i in range(depth):
            at = mix(at * np.uint64(0x9E3779B97F4A7C15) + values[..., i].astype(np.uint64) + np.uint64(1))
    return at


def chance(similarity: float, depth: int) -> float:
    return 1.0 - (1.0 - similarity**depth) ** TREES


def depths_for(similarity: float, target: float) -> list[int]:
    """Prefix lengths, longest first, down to the first at which a pair of this similarity is met with chance ``target``."""
    enough = [chance(similarity, d) >= target for d in DEPTHS]
    return list(DEPTHS[: enough.index(True) + 1 if True in enough else len(DEPTHS)])


def _mark(text: str | None) -> tuple[bytes | None, bytes | None]:
    marks = shingles(text)
    return (fingerprint(marks), labels(marks).tobytes()) if len(marks) else (None, None)


def _text_key(text: Column) -> list[Column]:
    """128 bits of a text, made by built-in functions."""
    return [F.xxhash64(text), F.xxhash64(F.lit("text"), text)]


def _describe(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, fp, labels); t1 and t2 stand for the text."""
    t1, t2 = _text_key(F.col("text"))
    return docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), text_udf(_MARK, lambda: _mark)(F.col("text")).alias("_m")).select("doc_id", "t1", "t2", "_m.*")


def _hanging(classes: DataFrame, depths: list[int]) -> DataFrame:
    """(fp, tree, nodes): the nodes of a class in each tree, shortest prefix first."""

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, many = _values(batch.column("labels").to_pylist()), len(batch)
            at = np.stack([nodes(values, depth) for depth in sorted(depths)], axis=-1).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) + 1, len(depths), dtype=np.int32)), pa.array(at))
            yield pa.RecordBatch.from_arrays([
                batch.column("fp").take(pa.array(np.repeat(np.arange(many), TREES))),
                pa.array(np.tile(np.arange(TREES, dtype=np.int32), many)), lists], names=["fp", "tree", "nodes"])

    return classes.select("fp", "labels").mapInArrow(hang, f"{_CLASS}, tree int, nodes array<long>")


def _values(labels_: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(labels_), np.uint32).reshape(-1, TREES, DEPTHS[0])


def _in_company(hanging: DataFrame, depths: list[int]) -> DataFrame:
    """(fp, depth, tree, node) of all nodes at any depth, where the node of the shortest prefix holds two or more classes."""
    short = F.col("nodes")[0]
    full = hanging.groupBy("tree", short.alias("_short")).agg(F.count("*").alias("n")).where("n > 1").select(F.col("tree").alias("_tree"), "_short")
    left = hanging.join(full, (F.col("tree") == F.col("_tree")) & (short == F.col("_short")), "left_semi")
    at = F.arrays_zip(F.lit(sorted(depths)).alias("depth"), F.col("nodes").alias("node"))
    return left.select("fp", "tree", F.explode(at).alias("_at")).select("fp", F.col("_at.depth").alias("depth"), "tree", F.col("_at.node").alias("node"))


def _own_nodes(hanging: DataFrame) -> DataFrame:
    """(depth, tree, node, n) of the nodes with two or more classes, those with the same classes once: the deepest, then the first."""
    full = hanging.groupBy("depth", "tree", "node").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("h2")).where("n > 1")
    first = F.max_by(F.struct("depth", "tree", "node"), F.struct("depth", -F.col("tree"), "node")).alias("_first")
    return full.groupBy("n", "h1", "h2").agg(first).select("_first.*", "n")


def open_pairs(left: np.ndarray, right: np.ndarray, depth: int, tree: int, alone: bool) -> np.ndarray:
    """Which pairs of two sides belong to this depth and tree: no longer common prefix, none as long in an earlier tree."""
    open_ = np.triu(np.ones((len(left), len(left)), bool), 1) if alone else np.ones((len(left), len(right)), bool)
    for length, trees in ((depth, range(tree)), (depth + 1, range(TREES) if depth < DEPTHS[0] else ())):
        near = [nodes(v, length) for v in (left, right)] if len(trees) else []
        for t in trees:
            open_ &= near[0][:, t][:, None] != near[1][:, t][None, :]
    return open_


_GROUP = ["depth", "tree", "node", "low", "high"]


def _sides(key: tuple, part: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    low, high = key[3:]
    return (part, part) if low == high else (part[part["block"] == low], part[part["block"] == high])


def _with_partner(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """The classes of two blocks that have an open pair there."""
    left, right = _sides(key, part)
    depth, tree, _, low, high = key
    if not len(left) or not len(right):
        return part[:0]
    open_ = open_pairs(_values(left["labels"]), _values(right["labels"]), depth, tree, low == high)
    if low == high:
        return left[open_.any(axis=0) | open_.any(axis=1)]
    return pd.concat([left[open_.any(axis=1)], right[open_.any(axis=0)]])


def _members(classes: DataFrame, depths: list[int]) -> DataFrame:
    """(fp, block, depth, tree, node, low, high): the classes that a pair of blocks has to verify."""
    hanging = cut(_in_company(_hanging(classes, depths), depths))
    own = cut(_own_nodes(hanging))
    blocks = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").cast("int")
    dealt = (
        hanging.join(own, ["depth", "tree", "node"]).withColumn("_blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("fp"), "_blocks").cast("int"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_to"))
        .withColumns({"low": F.least("block", "_to"), "high": F.greatest("block", "_to")})
        .select("fp", "n", "block", *_GROUP))
    names = "fp binary, block int, depth int, tree int, node long, low int, high int"
    large = dealt.where(f"n > {SMALL}").drop("n").join(classes.select("fp", "labels"), "fp")
    thinned = large.groupBy(*_GROUP).applyInPandas(lambda key, part: _with_partner(key, part)[_names(names)], names)
    return cut(dealt.where(f"n <= {SMALL}").select(*_names(names)).unionByName(thinned))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, marks) of the wanted classes (fp, one), read again from the text of one of their rows."""
    t1, t2 = _text_key(F.col("text"))
    ids = wanted.select(F.col("one.doc_id").alias("_id"), F.col("one.t1").alias("_t1"), F.col("one.t2").alias("_t2"))
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (t1 == F.col("_t1")) & (t2 == F.col("_t2")), "left_semi")

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            # rows that repeat come one after the other
            changed = [t for t, before in zip(batch["text"], [last, *batch["text"][:-1]]) if t != before]
            last = batch["text"].iloc[-1] if len(batch) else last
            sets = [shingles(t) for t in changed]
            yield pd.DataFrame({"fp": [fingerprint(s) for s in sets], "marks": [s.tobytes() for s in sets]}, dtype=object)

    return texts.select("text").mapInPandas(collect, f"{_CLASS}, marks binary").dropDuplicates(["fp"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over slices of the shared shingles."""
    if len(left) * len(right) <= 4:
        return np.array([[np.isin(a, b, assume_unique=True).sum() for b in right] for a in left], np.int64)
    left_all, right_all = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(left_all, right_all)
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets, everything in ((left, left_all), (right, right_all)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.minimum(np.searchsorted(shared, everything), max(len(shared) - 1, 0))
        real = shared[place] == everything if len(shared) else np.zeros(len(everything), bool)
        place, row = place[real], row[real]
        order = np.argsort(place, kind="stable")
        sides.append((place[order], row[order]))
    step = 4096
    for a in range(0, len(shared), step):
        blocks = []
        for (place, row), sets in zip(sides, (left, right)):
            x, y = np.searchsorted(place, [a, a + step])
            block = np.zeros((len(sets), min(step, len(shared) - a)), np.float32)
            block[row[x:y], place[x:y] - a] = 1.0
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out.astype(np.int64)


def _forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            kept.append((i, j))
    return kept


_VERIFIED = "fp binary, other binary, classes long, members long"


def _verifier(similarity: float):
    """Exact links between the classes of two blocks of a node."""

    def verify(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        depth, tree, _, low, high = key
        left, right = _sides(key, part)
        if low == high and len(left) < 2 or not len(left) or not len(right):
            return pd.DataFrame(columns=_names(_VERIFIED))
        open_ = open_pairs(_values(left["labels"]), _values(right["labels"]), depth, tree, low == high)
        if not open_.any():
            return pd.DataFrame(columns=_names(_VERIFIED))
        sets = [[np.frombuffer(b, np.uint64) for b in s["marks"]] for s in (left, right)]
        sizes = [np.array([len(s) for s in side]) for side in sets]
        common = overlaps(*sets)
        # exact in integers: common / union >= similarity
        num, den = similarity.as_integer_ratio() if similarity != 0.8 else (4, 5)
        linked = open_ & (den * common >= num * (sizes[0][:, None] + sizes[1][None, :] - common))
        weight = [s["size"].to_numpy() for s in (left, right)]
        classes = [linked.sum(axis=1), linked.sum(axis=0)]
        members = [(linked * weight[1][None, :]).sum(axis=1), (linked * weight[0][:, None]).sum(axis=0)]
        rows = []
        for side, n_classes, n_members in zip((left, right), classes, members):
            rows += [(fp, None, int(c), int(m)) for fp, c, m in zip(side["fp"], n_classes, n_members) if c]
        if linked.any():
            shift = 0 if low == high else len(left)
            names = list(left["fp"]) + ([] if low == high else list(right["fp"]))
            links = zip(*(x.tolist() for x in np.nonzero(linked)))
            rows += [(names[i], names[j], 0, 0) for i, j in _forest(len(names), ((i, j + shift) for i, j in links))]
        return pd.DataFrame(rows, columns=_names(_VERIFIED))

    return verify


def components(edges: DataFrame, a: str = "fp", b: str = "other") -> DataFrame:
    """(node, root) of every node with an edge, by large-star and small-star rounds (Kiveris et al., 2014)."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select(F.col("v"), F.col("u"))).toDF("u", "v") if large else pairs
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        joined = both.join(least, "u")
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        else:
            moved = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(joined.select("u", F.col("low").alias("v")))
        return moved.where("u > v").distinct()

    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges, last = cut(edges), None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = mark
        edges = cut(star(star(edges, True), False))


def _linked(docs: DataFrame, similarity: float, target: float) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, t1, t2, fp, labels), and per class _fp, its root, class_id, group_id, n_links, n_linked_classes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = cut(_describe(docs))
    one = F.min_by(F.struct("doc_id", "t1", "t2"), F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2"))
    classes = cut(described.where("fp IS NOT NULL").groupBy("fp").agg(
        F.min("doc_id").alias("doc_id"), one.alias("one"), F.count("*").alias("size"), F.first("labels").alias("labels")))
    members = _members(classes, depths_for(similarity, target))
    sets = cut(_sets(docs, classes.join(members.select("fp").distinct(), "fp", "left_semi").select("fp", "one")))
    filled = members.join(classes.select("fp", "size", "labels").join(sets, "fp"), "fp")
    every = cut(filled.groupBy(*_GROUP).applyInPandas(_verifier(similarity), _VERIFIED))
    counts = every.where("classes > 0").groupBy("fp").agg(F.sum("classes").alias("classes"), F.sum("members").alias("members"))
    roots = components(every.where("other IS NOT NULL"))
    told = classes.select("fp", F.col("doc_id").alias("class_id"), "size").join(counts, "fp", "left").join(
        roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    heads = told.where("classes > 0").groupBy("root").agg(F.min("class_id").alias("group_id"))
    told = told.join(heads, "root", "left").select(
        F.col("fp").alias("_fp"), "root", "class_id", F.coalesce("group_id", "class_id").alias("group_id"),
        (F.col("size") - 1 + F.coalesce("members", F.lit(0))).alias("n_links"), F.coalesce("classes", F.lit(0)).alias("n_linked_classes"))
    return described, told


def jaccard_links(docs: DataFrame, similarity: float = SIMILARITY, target: float = TARGET) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id, group_id, n_links, n_linked_classes.

    class_id is the least doc_id with the same shingles, group_id the least
    one that links lead to, n_links the number of other rows with similarity
    ``similarity`` or more, n_linked_classes the classes among them.
    """
    described, told = _linked(docs, similarity, target)
    return described.join(told, F.col("fp") == F.col("_fp"), "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("group_id", "doc_id").alias("group_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_linked_classes", F.lit(0)).alias("n_linked_classes"))


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, target: float = TARGET) -> DataFrame:
    """The rows of ``docs`` that have no near copy, and one row of each group of near copies.

    The one with the least doc_id stays, a null coming last; of several with
    that doc_id one class of texts, and of it the least text. Rows are told
    apart by doc_id and class, so one of another group, or of none, that
    shares a doc_id with a copy is not touched.
    """
    described, told = _linked(docs, similarity, target)
    copies = cut(described.select("doc_id", "fp").join(told.where("n_links > 0").select("_fp", "root"), F.col("fp") == F.col("_fp"))
                 .groupBy("root", "fp", "doc_id").agg(F.count("*").alias("rows")))
    first = copies.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")).alias("first"))
    judged = copies.join(first, "root").select(
        "doc_id", "fp", "rows", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("fp") == F.col("first.fp"))).alias("stays"))
    names = [free_name(docs, n) for n in ("_id", "_t1", "_t2", "_fp", "_d1", "_d2")]
    id_name, t1_name, t2_name, fp_name, d1_name, d2_name = names
    # by text, as the rows of a class may have several
    texts = described.select(F.col("doc_id").alias(id_name), F.col("t1").alias(t1_name), F.col("t2").alias(t2_name), F.col("fp").alias(fp_name)).distinct()
    marks = cut(texts.join(judged, F.col(id_name).eqNullSafe(F.col("doc_id")) & (F.col(fp_name) == F.col("fp"))).select(*names[:4], "rows", "stays"))
    d1, d2 = _text_key(F.col("text").cast("string"))
    marked = docs.withColumns({d1_name: d1, d2_name: d2})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_name)) & (F.col(d1_name) == F.col(t1_name)) & (F.col(d2_name) == F.col(t2_name))
    kept = marked.join(marks.where("NOT stays").select(*names[:3]), same, "left_anti")
    twice = marks.where("stays AND rows > 1").select(*names[:4])
    if twice.isEmpty():
        return kept.drop(d1_name, d2_name)
    whole = F.struct(*[F.col(c) for c in docs.columns])
    one = kept.join(twice, same).groupBy(id_name, fp_name).agg(F.min_by(whole, F.col("text").cast("string")).alias("one")).select("one.*")
    return kept.join(twice.select(*names[:3]), same, "left_anti").drop(d1_name, d2_name).unionByName(one)
