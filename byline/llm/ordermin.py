"""Near-dedup by Order MinHash.

A text is its sequence of shingles of ``width`` words, repeated shingles told apart by their occurrence number. A sketch
holds, for each of ``sketches`` hash orders, the ``picked`` least shingles in the order of the text, so two texts share an
entry with a probability that falls with their edit distance, not only with their common shingles. Texts that share
an entry are candidates; a banded alignment of the shingle sequences decides. The similarity is the share of aligned
shingles: aligned / (shingles of both - aligned); texts link at ``threshold`` or more.

Nothing is paired within a bucket at first: each text is verified against the least one of its buckets, and what links
collapses. Components that still share buckets, and whose short MinHash signatures do not rule a link out, form
families. A family is compared across its components in tiles of bounded size: one matrix product counts the common
shingles of all pairs of a tile, and only pairs with enough of them are aligned. Tiles give back links enough to
join components, never pairs. Equal texts are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byline.llm.components import components
from byline.llm.staging import likely_in, staged, tagged_once, text_or_empty
from byline.llm.words import mix, runs, words_of

SIGNATURE = 64
#: A signature may fall this many standard deviations short of the threshold before its pair is dismissed.
SLACK = 5.0
TILE, HUB = 256, 64
PIECE = 1 << 22
_draw = np.random.Generator(np.random.PCG64(71))
_XOR, _TIMES = _draw.integers(0, 1 << 63, (2, 1024), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The shingles of one text's words; a text shorter than a shingle is one shingle if it has a word."""
    return runs(hashes, min(width, len(hashes))) if len(hashes) else hashes


def labelled(x: np.ndarray) -> np.ndarray:
    """Values with their occurrence number mixed in: all different."""
    order = np.argsort(x, kind="stable")
    y = x[order]
    starts = np.concatenate([[0], np.flatnonzero(y[1:] != y[:-1]) + 1])
    nth = np.arange(len(y)) - np.repeat(starts, np.diff(np.append(starts, len(y))))
    out = np.empty_like(x)
    out[order] = np.where(nth == 0, y, mix(y + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def sketch(x: np.ndarray, sketches: int, picked: int) -> np.ndarray:
    """The entries of a text's sketch as hashes; ``x`` are its shingles, at least one."""
    label = labelled(x)
    take = min(picked, len(x))
    out = np.empty(sketches, np.uint64)
    step = max(1, (1 << 22) // len(x))
    for a in range(0, sketches, step):
        b = min(sketches, a + step)
        order = (label[None, :] ^ _XOR[a:b, None]) * _TIMES[a:b, None]
        least = np.argpartition(order, take - 1, axis=1)[:, :take] if take < len(x) else np.broadcast_to(np.arange(len(x)), (b - a, len(x)))
        entry = np.arange(a + 1, b + 1, dtype=np.uint64)
        for column in np.sort(least, axis=1).T:  # in the order of the text
            entry = mix(entry * np.uint64(0xD6E8FEB86659FD93) + x[column])
        out[a:b] = entry
    return out


def signature(x: np.ndarray) -> bytes:
    """One byte of the least value under each of SIGNATURE orders."""
    label, at = labelled(x), np.empty(SIGNATURE, np.int64)
    step = max(1, (1 << 22) // len(x))
    for a in range(0, SIGNATURE, step):
        b = min(SIGNATURE, a + step)
        at[a:b] = np.argmin((label[None, :] ^ _XOR[512 + a:512 + b, None]) * _TIMES[512 + a:512 + b, None], axis=1)
    return (label[at] >> np.uint64(24)).astype(np.uint8).tobytes()


def _sketches(width: int, sketches: int, picked: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                words = words_of(part.column("text"))
                node, size, sig, keys, seen = [], [], [], [], set()
                for i, name in enumerate(part.column("node").to_pylist()):
                    if name in seen or words.first[i] == words.first[i + 1]:
                        continue
                    seen.add(name)
                    x = shingles(words.hash[words.of(i)], width)
                    node.append(name)
                    size.append(len(x))
                    sig.append(signature(x))
                    keys.append(np.unique(sketch(x, sketches, picked)).view(np.int64))
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                flat = np.concatenate([*keys, np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.binary()),
                                                  pa.ListArray.from_arrays(ends, flat)], ["node", "size", "sig", "keys"])
    return run


def _least_equal(threshold: float) -> int:
    """Equal signature bytes below which two texts are surely less similar than ``threshold``."""
    spread = np.sqrt(threshold * (1 - threshold) / SIGNATURE)
    return int(np.floor(SIGNATURE * (threshold - SLACK * spread)))


def _may_match(threshold: float):
    """Keeps pairs whose sizes and signatures allow the threshold."""
    least = _least_equal(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for c in ("sig_a", "sig_b"))
            m, n = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
            ok = ((a == b).sum(1) >= least) & (np.minimum(m, n) >= threshold * np.maximum(m, n) - 1e-9)
            yield batch.filter(pa.array(ok)).select(["a", "b"])
    return run


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[list[dict]]:
    """Rows of sorted batches, one list per run of equal ``by``."""
    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[c] for c in by)
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held


def _forest(links: Iterator[tuple[int, int]], up: np.ndarray) -> Iterator[tuple[int, int]]:
    """Those of the links that join what was apart; ``up`` maps to components and is brought up to date."""
    for x, y in links:
        a, b = up[x], up[y]
        if a != b:
            up[up == b] = a
            yield x, y


def _family_links(threshold: float):
    """Within a tile of a bucket, labels joined by pairs that sizes and signatures allow: one less than labels at most."""
    least = _least_equal(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["key", "i", "j"]):
            sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(-1, SIGNATURE)
            size, part = np.array([r["size"] for r in rows]), np.array([r["part"] for r in rows])
            names, label = np.unique([r["label"] for r in rows], return_inverse=True)
            i, j = rows[0]["i"], rows[0]["j"]
            right = np.flatnonzero(part == j)
            up, out = np.arange(len(names)), []
            for x in np.flatnonzero(part == i).tolist():
                at = right[up[label[right]] != up[label[x]]]
                at = at[np.minimum(size[at], size[x]) >= threshold * np.maximum(size[at], size[x]) - 1e-9]
                at = at[(sig[at] == sig[x]).sum(1) >= least]
                out += _forest(((label[x], label[y]) for y in at.tolist()), up)
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in out], pa.binary()), pa.array([names[y] for _, y in out], pa.binary())], ["a", "b"])
    return run


def common_counts(a: list[np.ndarray], b: list[np.ndarray], cells: int = 1 << 23) -> np.ndarray:
    """How many values each of ``a`` has in common with each of ``b``; values of one array differ."""
    flat = np.concatenate(a + b)
    row = np.repeat(np.arange(len(a) + len(b)), list(map(len, a + b)))
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    more = times[column] > 1
    _, column = np.unique(column[more], return_inverse=True)
    row, out = row[more], np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1, cells // (len(a) + len(b)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        held = np.zeros((len(a) + len(b), width), np.float32)
        held[row[lo:hi], column[lo:hi] - start] = 1
        out += held[:len(a)] @ held[len(a):].T
    return out


def _tile_links(width: int, threshold: float):
    """Within a tile of a family, verified links that join components that were apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["family", "kind", "i", "j"]):
            words = words_of(pa.array([r["text"] for r in rows], pa.string()))
            cut = [shingles(words.hash[words.of(k)], width) for k in range(len(rows))]
            marked = [labelled(x) for x in cut]
            up = np.unique([r["label"] for r in rows], return_inverse=True)[1]
            left = [k for k, r in enumerate(rows) if r["left"]]
            right = [k for k, r in enumerate(rows) if r["right"]]
            out = []
            if left and right:
                size = np.array(list(map(len, cut)))
                common = common_counts([marked[k] for k in left], [marked[k] for k in right])
                need = threshold / (1 + threshold) * (size[left][:, None] + size[right][None, :]) - 1e-9
                r, c = np.nonzero((common >= need) & (up[left][:, None] != up[right][None, :]))
                for x, y in zip(np.array(left)[r].tolist(), np.array(right)[c].tolist(), strict=True):
                    if up[x] != up[y] and aligned_enough(cut[x], cut[y], threshold):
                        up[up == up[y]] = up[x]
                        out.append((rows[x]["node"], rows[y]["node"]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])
    return run


def banded_common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The most values of a and b that align in order, partners at most ``band`` places apart: one row of bits per value of a."""
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    open_, window = full, (1 << (2 * band + 1)) - 1
    for i, x in enumerate(a.tolist()):
        hit = places.get(x, 0)
        if hit:
            hit &= window << (i - band) if i >= band else window >> (band - i)
            taken = open_ & hit
            open_ = ((open_ + taken) | (open_ - taken)) & full
    return len(b) - open_.bit_count()


def aligned_enough(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether aligned / (len(a) + len(b) - aligned) reaches ``threshold``."""
    need = int(np.ceil(threshold / (1 + threshold) * (len(a) + len(b)) - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    x, y = labelled(a), labelled(b)
    _, at, bt = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if len(at) < need:
        return False  # not even as many in common
    order = bt[np.argsort(at)]
    if (order[1:] > order[:-1]).all():
        return True  # all that is in common stands in the same order
    return banded_common(a, b, len(a) + len(b) - 2 * need) >= need


def _verify(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            words = words_of(batch.column("text"))
            a, b = [], []
            for i, (x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                own = shingles(words.hash[words.of(i)], width)
                if y is None:
                    hub, held = x, own
                elif x == hub and aligned_enough(held, own, threshold):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
    return run


def _texts_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of some distinct nodes, once each; the others are left out before the shuffle.

    The join is inner, for the optimizer would move a semi join, and its shuffle, below the filter."""
    return staged(likely_in(rows, nodes, "node").join(nodes, "node").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, rows: DataFrame, width: int, threshold: float) -> DataFrame:
    """Those of the ``pairs`` (a, b) that align. A hub's partners come in parts of about HUB, each with the hub's text."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = _texts_of(rows, staged(nodes))
    degree = staged(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    parts = pairs.join(degree, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / HUB)).cast("int")).select("a", "part", "b")
    parts = staged(parts)
    members = parts.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    hubs = (parts.select("a", "part").distinct().join(texts.withColumnRenamed("node", "a"), "a")
            .select("a", "part", F.lit(None).cast("binary").alias("b"), "text"))
    dealt = members.unionByName(hubs).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return staged(dealt.select("a", "b", "text").mapInArrow(_verify(width, threshold), "a binary, b binary"))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, sketches: int = 20, picked: int = 3,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (least id of its class), ``class_size`` and ``kept`` (one row per class).

    A class is what links and equality of texts connect. With the defaults a pair at the threshold is missed with a
    probability of about one in a million, more similar pairs less. Words are runs of characters other than ASCII blanks. Null
    texts count as empty; empty and blank texts link only with equal ones. A text of fewer than ``width`` words is one
    shingle. Rows without an id are members like others but name a class only if no row has an id. Of repeated
    rows one is kept. An empty table gives an empty result.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_tag"))
    return _classes(narrow, width, threshold, sketches, picked).drop("_tag").withColumnRenamed("_id", id_col)


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, sketches: int = 20, picked: int = 3,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of ``near_duplicates``, that with the least id. The rows are numbered once, in a
    stored copy."""
    tagged, tag = tagged_once(docs)
    narrow = tagged.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(tag).alias("_tag"))
    losers = staged(_classes(narrow, width, threshold, sketches, picked).where("not kept").select(F.col("_tag").alias(tag)))
    return tagged.join(losers, tag, "left_anti").drop(tag)


def _classes(tagged: DataFrame, width: int, threshold: float, sketches: int, picked: int) -> DataFrame:
    text = text_or_empty(F.col("_text"))
    rows = tagged.select(F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("node"), text.alias("text"))
    members = staged(tagged.select(F.col("_id").alias("id"), "_tag", F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("node")))
    known = staged(rows.mapInArrow(_sketches(width, sketches, picked), "node binary, size bigint, sig binary, keys array<bigint>")
                   .dropDuplicates(["node"]))
    entries = known.select("node", F.explode("keys").alias("key"))
    buckets = staged(entries.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    held = staged(entries.join(buckets, "key"))
    stars = held.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda c: known.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sig").alias(f"sig_{c}"))
    likely = staged(stars.join(side("a"), "a").join(side("b"), "b").mapInArrow(_may_match(threshold), "a binary, b binary"))
    edges = _verified(likely, rows, width, threshold)
    label = components(edges)
    more = _across(held, known, label, rows, width, threshold)
    if more is not None:
        label = components(edges.unionByName(more))
    placed = staged(members.join(label, "node", "left").select("id", "_tag", F.coalesce("component", "node").alias("class")))
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"), F.col("_tag").alias("tag")))
    classes = staged(placed.groupBy("class").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size")))
    return placed.join(classes, "class").select(
        F.col("id").alias("_id"), "_tag", F.col("first.id").alias("class_id"), "class_size", (F.col("first.tag") == F.col("_tag")).alias("kept"))


def _across(held: DataFrame, known: DataFrame, label: DataFrame, rows: DataFrame, width: int, threshold: float) -> DataFrame | None:
    """Links between texts of one bucket that the comparison with its least text left in different components."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    named = staged(held.where("n > 2").select("key", "node").join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")))
    mixed = staged(named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n"))
                   .where("x <> y").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("parts")))
    tiles = (named.join(mixed, "key").join(known.select("node", "size", "sig"), "node")
             .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", each("parts"))
             .withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
             .select("key", "i", "j", "part", "label", "size", "sig")
             .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"))
    family = components(tiles.mapInArrow(_family_links(threshold), "a binary, b binary"))
    if family.isEmpty():
        return None
    family = family.select(F.col("node").alias("label"), F.col("component").alias("family"))
    member = staged(known.select("node").join(label, "node", "left").select("node", F.coalesce("component", "node").alias("label"))
                    .join(family, "label").select("node", "label", "family"))
    # the largest component of a family is not compared with itself: only its other texts meet it and each other
    sizes = staged(member.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n")))
    cores = staged(sizes.groupBy("family").agg(F.max(F.struct("n", "label")).alias("core"), F.sum("n").alias("all"))
                   .select("family", F.col("core.label").alias("core"), F.ceil(F.col("core.n") / TILE).cast("int").alias("cores"),
                           F.ceil((F.col("all") - F.col("core.n")) / TILE).cast("int").alias("rests")))
    sided = member.join(cores, "family").withColumn("in_core", F.col("label") == F.col("core"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    keep = ["family", "kind", "i", "j", "node", "label", "left", "right"]
    yes, no = F.lit(True), F.lit(False)
    rest = sided.where("not in_core").withColumn("part", part("rests"))
    core_side = sided.where("in_core").withColumns({"kind": F.lit(1), "i": part("cores"), "left": yes, "right": no}).withColumn("j", each("rests"))
    rest_side = rest.withColumns({"kind": F.lit(1), "j": F.col("part"), "left": no, "right": yes}).withColumn("i", each("cores"))
    among = rest.withColumn("other", each("rests")).withColumns(
        {"kind": F.lit(0), "i": F.least("part", "other"), "j": F.greatest("part", "other"),
         "left": F.col("part") <= F.col("other"), "right": F.col("part") >= F.col("other")})
    asked = core_side.select(keep).unionByName(rest_side.select(keep)).unionByName(among.select(keep))
    texts = _texts_of(rows, member.select("node"))
    dealt = asked.join(texts, "node").repartition("family", "kind", "i", "j").sortWithinPartitions("family", "kind", "i", "j")
    return staged(dealt.mapInArrow(_tile_links(width, threshold), "a binary, b binary"))
