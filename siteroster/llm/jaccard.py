"""Exact Jaccard join on word shingles by vertical partitioning.

The distinct shingles of a document are put into one global order: rare ones first, by hash among equals. The
order is cut into fragments. A document's set falls into one segment per fragment, the overlap of two
documents is counted in each fragment on its own, and the counts are summed per pair.

* Order. A count of all shingles, in a table of fixed size, tells frequent shingles from rare ones. It decides
  only how early a shingle stands, so that a wrong guess costs time and no link.
* Candidates. Two documents with similarity t share a shingle among the first n - ceil(t * n) + 1 of each in
  the order. Frequent shingles stand last, so a passage that many documents share brings no candidates.
* Links. Documents with equal sets are one class. Then two rounds: each document is compared with the one
  of the documents with which it meets most often that has the fewest rare shingles (a hub), which links large
  groups of near copies by about one comparison per document; after that, all remaining candidates that lie
  in different components are compared, unless the number of first shingles that they share, or the places
  of these, rule out the similarity. So every two documents that are linked end up in one component.
* Skew. Shingles of very many documents and hubs of very many members are split over salts.

Words are runs of anything but ASCII white space, with A-Z in lower case. With fewer words than a shingle
has, the whole sequence is the only shingle. NULL and empty texts have no shingles and no links. NULL ids
take no part: they come back with a NULL component. ``doc_id`` names one text; repeated rows are repeated in the result.
An empty table gives no rows. Sets are of 64-bit hashes; the counts are exact for these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteroster.llm.common import HASHES, free_name, rolling, runs, tidy, whole_number
from siteroster.llm.components import components
from siteroster.llm.sift import sift
from siteroster.session import durable

WIDTH = 5
#: Similarity from which two documents are linked, as a fraction.
NUM, DEN = 4, 5
#: Size of the table of counts, and of the blocks in which it is summed.
COUNTERS, BLOCK = 1 << 21, 1 << 16
FRAGMENTS = 8
#: Rows of one key that are worked on together.
HOT = 1 << 17


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    words = [(t or "").encode().lower().split() for t in texts]
    values = np.concatenate([np.zeros(0, np.uint64), *[HASHES.of(w) for w in words]])
    grams = rolling(values, width)
    out, at = [], 0
    for w in words:
        if len(w) >= width:
            out.append(np.unique(grams[at:at + len(w) - width + 1]))
        else:
            out.append(rolling(values[at:at + len(w)], len(w)) if w else np.zeros(0, np.uint64))
        at += len(w)
    return out


def _mapper(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, text_at):
                if (out := work(part)) is not None:
                    yield out
    return run


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("block", pa.int32()),
                      ("counts", pa.binary())])


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with size and 128-bit signature of its set; at the end the counts of the task."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for part in runs(batch, 1):
            sets = shingle_sets(part.column(1).to_pylist())
            counts += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_PROFILE)
    used = [b for b in range(COUNTERS // BLOCK) if counts[b * BLOCK:(b + 1) * BLOCK].any()]
    if used:
        n, none = len(used), pa.nulls(len(used), pa.int64())
        kind = "<u2" if counts.max() < 1 << 16 else "<u8"
        data = [counts[b * BLOCK:(b + 1) * BLOCK].astype(kind).tobytes() for b in used]
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(used, pa.int32()), pa.array(data)], schema=_PROFILE)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the blocks of counts, one after the other."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = data.as_buffer()
            counts = np.frombuffer(raw, "<u2" if len(raw) == 2 * BLOCK else "<u8")
            if block in total:
                total[block] += counts.astype(np.int64)
            else:
                total[block] = counts.astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()])],
                                         names=["block", "counts"])


def frequency_classes(profile: DataFrame) -> tuple[np.ndarray, float]:
    """Class of each counter (0: no more than chance makes of rare shingles; each next class 1.4 times as
    many), and the count at which class 1 begins. The table has a fixed size, whatever the input."""
    blocks = (profile.filter(F.col("block").isNotNull()).select("block", "counts").repartition(COUNTERS // BLOCK, "block")
              .mapInArrow(tidy(_summed), "block int, counts binary"))
    counts = np.zeros(COUNTERS, np.int64)
    for block, data in blocks.collect():
        counts[block * BLOCK:(block + 1) * BLOCK] += np.frombuffer(data, np.int64)
    middle = float(np.median(counts))
    least = middle + 3 * max(middle, 1) ** 0.5 + 4
    return np.where(counts > least, np.minimum(63, 1 + 2 * np.log2(np.maximum(counts, 1) / least)), 0).astype(np.uint8), least


def _ordered(shingles: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Places of shingles in the global order: class above, hash below."""
    top = classes[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(57)
    return np.sort(top | (shingles >> np.uint64(7)))


def prefix_length(n: Column) -> Column:
    return n - F.ceil(n * NUM / DEN) + 1


def prefixes(docs: DataFrame, classes) -> DataFrame:
    """(token, doc_id, n, place) of the first shingles of each document in the global order."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        tokens, docs_at, sizes, places = [], [], [], []
        for i, s in enumerate(shingle_sets(part.column(1).to_pylist())):
            p = len(s) - -(-len(s) * NUM // DEN) + 1 if len(s) else 0
            tokens.append(_ordered(s, classes.value)[:p])
            docs_at.append(np.full(p, i))
            sizes.append(np.full(p, len(s), np.int32))
            places.append(np.arange(p, dtype=np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(tokens).view(np.int64)), part.column(0).take(pa.array(np.concatenate(docs_at))),
             pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["token", "doc_id", "n", "place"])
    return docs.mapInArrow(tidy(_mapper(work, 1)), "token long, doc_id long, n int, place int")


def _similar_sizes(a: str, b: str) -> Column:
    return NUM * F.greatest(a, b) <= DEN * F.least(a, b)


def _needed(a: str, b: str) -> Column:
    """Overlap that two sets of these sizes need."""
    return F.ceil(NUM * (F.col(a) + F.col(b)) / (NUM + DEN))


_COMPARED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("fragment", pa.int32()), ("na", pa.int32()), ("nb", pa.int32()), ("shared", pa.int32())])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlap of a hub's segment, which comes first, with those of its members, row after row."""
    at, hub, size = None, None, 0
    for batch in batches:
        rows = {c: [] for c in _COMPARED.names}
        keys = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))))
        mine, docs, n = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()
        for i, key in enumerate(keys):
            segment = np.frombuffer(batch.column(6)[i].as_buffer(), np.uint64)
            if mine[i] == 0:
                at, hub, size = key, segment, n[i]
            elif at == key:
                slot = np.searchsorted(hub, segment)
                slot[slot == len(hub)] = 0
                shared = int((hub[slot] == segment).sum()) if len(hub) else 0
                for c, v in zip(_COMPARED.names, (key[0], docs[i], key[2], size, n[i], shared)):
                    rows[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _COMPARED], schema=_COMPARED)


def fragments_of(shingles: np.ndarray, classes: np.ndarray, fragments: int = FRAGMENTS) -> list[np.ndarray]:
    """A set cut by the global order: equal steps of its rare part, and the frequent shingles behind them, each sorted by hash."""
    rare = classes[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)] == 0
    at = np.where(rare, ((shingles >> np.uint64(32)) * np.uint64(fragments - 1)) >> np.uint64(32), np.uint64(fragments - 1))
    order = np.argsort(at, kind="stable")
    return np.split(shingles[order], np.searchsorted(at[order], np.arange(1, fragments, dtype=np.uint64)))


def verified(docs: DataFrame, pairs: DataFrame, classes, fragments: int = FRAGMENTS) -> DataFrame:
    """(a, b): the pairs whose sets are similar. Overlaps are counted per fragment of the order and summed per pair.

    Segments of ``a`` (the hub) and its ``b`` meet by (a, salt, fragment); the number of salts grows with the members.
    """
    pairs = durable(pairs.select("a", "b").distinct(), "pairs")
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select(
        F.col("b").alias("_id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"),
        F.lit(1).alias("part"))
    hubs = salts.select(F.col("a").alias("_id"), F.col("a").alias("hub"),
                        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("part"))
    wanted = durable(members.unionByName(hubs), "wanted")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column(1).to_pylist())
        segments = [x.tobytes() for s in sets for x in fragments_of(s, classes.value, fragments)]
        row = pa.array(np.repeat(np.arange(len(sets)), fragments))
        return pa.RecordBatch.from_arrays(
            [part.column(2).take(row), part.column(3).take(row), pa.array(np.tile(np.arange(fragments, dtype=np.int32), len(sets))),
             part.column(4).take(row), part.column(0).take(row), pa.array(np.repeat([len(s) for s in sets], fragments).astype(np.int32)),
             pa.array(segments, pa.binary())], names=["hub", "salt", "fragment", "part", "doc_id", "n", "segment"])

    # only the texts that are compared move
    segments = (sift(docs, "doc_id", wanted, "_id").join(wanted, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "hub", "salt", "part")
                .mapInArrow(tidy(_mapper(work, 1)), "hub long, salt int, fragment int, part int, doc_id long, n int, segment binary"))
    met = segments.repartition("hub", "salt", "fragment").sortWithinPartitions("hub", "salt", "fragment", "part")
    partial = met.mapInArrow(tidy(_overlaps), "a long, b long, fragment int, na int, nb int, shared int")
    per_fragment = partial.groupBy("a", "b", "fragment").agg(  # repeated rows of a document count once
        F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("shared").alias("shared"))
    return (per_fragment.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"))
            .filter(DEN * F.col("shared") >= NUM * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b"))


def _meetings(docs: DataFrame, classes, least: float) -> DataFrame:
    """First shingles that two documents or more share, with the hub of each: token, doc_id, n, place, hub, whole.

    Shingles of very many documents are split over salts, each with a hub of its own; ``whole`` says
    that there is but one salt.
    """
    level = F.shiftrightunsigned("token", 57)
    salts = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (level - 1) / 2) * least / HOT)
    found = prefixes(docs, classes).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.ceil(salts)).cast("int"))
    same = W.partitionBy("token", "salt")
    hub = F.min(F.struct("place", "n", "doc_id")).over(same)
    return (found.withColumn("_hub", hub).withColumn("_many", F.count(F.lit(1)).over(same)).withColumn("_whole", F.ceil(salts) == 1)
            .filter((F.col("_many") > 1) | ~F.col("_whole"))
            .select("token", "doc_id", "n", "place", F.col("_hub.doc_id").alias("hub"), F.col("_hub.n").alias("hub_n"), F.col("_whole").alias("whole")))


def _hub_pairs(met: DataFrame, kinds: DataFrame) -> DataFrame:
    """For each document the hub that it meets most often, and for salted shingles the hubs among themselves;
    ``likely`` where a fifth of the first shingles meet there, a tenth being the least."""
    second = met.filter("not whole").groupBy("token", "hub", "hub_n").agg(F.lit(1).alias("_one"))
    over = second.groupBy("token").agg(F.min(F.struct("hub", "hub_n")).alias("_top"))
    upper = second.join(over, "token").select(F.col("_top.hub").alias("a"), F.col("_top.hub_n").alias("na"), F.col("hub").alias("b"), F.col("hub_n").alias("nb"))
    lower = met.select(F.col("hub").alias("a"), F.col("hub_n").alias("na"), F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    often = (lower.unionByName(upper).filter((F.col("a") != F.col("b")) & _similar_sizes("na", "nb"))
             .groupBy("b", "a").agg(F.max("nb").alias("nb"), F.count(F.lit(1)).alias("times")))
    most = F.max_by(F.struct("a", "times", "nb"), F.struct("times", -F.col("a")))
    best = (often.filter(10 * F.col("times") >= prefix_length(F.col("nb"))).groupBy("b").agg(most.alias("m"))
            .select(F.col("m.a").alias("a"), "b", (5 * F.col("m.times") >= prefix_length(F.col("m.nb"))).alias("likely")))
    return _between_kinds(best, kinds)


def _between_kinds(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Pairs between the first documents of different classes of equal sets, each once."""
    of = kinds.select("doc_id", "first")
    both = (pairs.join(of.select(F.col("doc_id").alias("a"), F.col("first").alias("_a")), "a")
            .join(of.select(F.col("doc_id").alias("b"), F.col("first").alias("_b")), "b").filter("_a != _b"))
    return both.groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.max("likely").alias("likely"))


_TAKEN = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _counted(group: pa.Table) -> pa.Table:
    """Candidates between the two sides of one pair of blocks, with the shared first shingles counted at once."""
    rows = group.to_pydict()
    side = np.array(rows["side"])
    own, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(own) or not len(others):
        return _TAKEN.empty_table()
    lists = rows["tokens"]
    known, slot = np.unique(np.concatenate([np.array(x, np.int64) for x in lists]), return_inverse=True)
    table = np.zeros((len(lists), len(known)), np.float32)
    table[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), slot] = 1
    times = (table[own] @ table[others].T).astype(np.int64)
    doc, n, first, component, residual = (np.array(rows[c]) for c in ("doc_id", "n", "first", "component", "residual"))
    na, nb = n[own][:, None], n[others][None]
    needed = -(-NUM * (na + nb) // (NUM + DEN))
    rest = np.maximum(n - prefix_size(n), 0)
    good = (component[own][:, None] != component[others][None]) & (NUM * np.maximum(na, nb) <= DEN * np.minimum(na, nb)) & (times > 0)
    good &= np.minimum(na - first[own][:, None], nb - first[others][None]) >= needed
    good &= times + np.maximum(rest[own][:, None], rest[others][None]) >= needed
    # two documents outside the main component meet twice
    good &= ~residual[others][None] | (doc[own][:, None] < doc[others][None])
    i, j = np.nonzero(good)
    return pa.table([doc[own][i], doc[others][j]], schema=_TAKEN)


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - -(-n * NUM // DEN) + 1


def _family_pairs(rows: DataFrame) -> DataFrame:
    """Candidates inside families. Documents outside the largest component of their family meet all others of the
    family, block by block; only pairs that may be similar leave a block."""
    whole = rows.groupBy("family", "component", "doc_id", "n", "first").agg(F.collect_list("token").alias("tokens"))
    whole = durable(whole, "family")  # a document's own first shingles only
    sizes = whole.groupBy("family", "component").agg(F.count(F.lit(1)).alias("k"))
    stats = sizes.groupBy("family").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("all"),
                                        F.max("k").alias("top")).filter("all > top")
    each = (whole.join(stats, "family").withColumn("residual", F.col("component") != F.col("main"))
            .withColumn("_cuts", F.ceil((F.col("all") - F.col("top")) / 512)).withColumn("_parts", F.ceil(F.col("all") / 512))
            .withColumn("_at", F.xxhash64("doc_id")))
    kept = ["family", "doc_id", "n", "first", "component", "residual", "tokens"]
    left = each.filter("residual").select(*kept, F.pmod("_at", "_cuts").alias("cut"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(0).alias("side"))
    right = each.select(*kept, F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)).alias("cut"), F.pmod("_at", "_parts").alias("part"), F.lit(1).alias("side"))
    return left.unionByName(right).groupBy("family", "cut", "part").applyInArrow(_counted, "a long, b long")


def _open_pairs(met: DataFrame, kinds: DataFrame, component: DataFrame, family: DataFrame) -> DataFrame:
    """Candidates in different components that no bound rules out.

    Documents that a common hub ties together are a family. Large groups of near copies are families, and are
    counted block by block; between families shared shingles are joined.
    """
    of = (kinds.filter("doc_id = first").select("doc_id")
          .join(component.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
          .join(family.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id", "left")
          .select("doc_id", F.coalesce("component", "doc_id").alias("component"), F.coalesce("family", "doc_id").alias("family")))
    rows = met.select("token", "doc_id", "n", "place").join(of, "doc_id")
    split = (rows.groupBy("token").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.min("family").alias("_one"),
                                       F.max("family").alias("_other")).filter("_low < _high")
             .select("token", (F.col("_one") < F.col("_other")).alias("mixed")))
    # nothing that a document shares with another component stands before its first open place
    rows = durable(rows.join(split, "token").distinct().withColumn("first", F.min("place").over(W.partitionBy("doc_id"))), "open")
    left, right = (rows.filter("mixed").select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "n", "place", "first", "component", "family")])
                   for side in "ab")
    met_twice = left.join(right, "token").filter(
        (F.col("family_a") < F.col("family_b")) & (F.col("component_a") != F.col("component_b")) & _similar_sizes("n_a", "n_b")
        & (F.least(F.col("n_a") - F.col("first_a"), F.col("n_b") - F.col("first_b")) >= _needed("n_a", "n_b")))
    # from the first shared place on, no more can be shared than what follows in the shorter rest
    fits = 1 + F.least(F.col("n_a") - F.col("place_a") - 1, F.col("n_b") - F.col("place_b") - 1) >= _needed("n_a", "n_b")
    # beyond the one's first shingles at most its rest is shared
    rest = F.greatest(F.col("n_a") - prefix_length(F.col("n_a")), F.col("n_b") - prefix_length(F.col("n_b")))
    between = (met_twice.groupBy("doc_id_a", "doc_id_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("times"), F.max(fits).alias("fits"))
               .filter(F.col("fits") & (F.col("times") + rest >= _needed("n_a", "n_b")))
               .select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")))
    return between.unionByName(_family_pairs(rows))


def linked_components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest id that a document reaches by links.

    ``TypeError`` for keys that are no whole numbers.
    """
    whole_number(docs, key)
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    profile = durable(chosen.mapInArrow(tidy(_profile), "doc_id long, n long, s1 long, s2 long, block int, counts binary"), "profile")
    rows = profile.filter(F.col("block").isNull()).select("doc_id", "n", "s1", "s2")
    classes, least = frequency_classes(profile)
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    named = rows.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    firsts = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("first"))
    kinds = durable(named.join(firsts, ["s1", "s2"]).select("doc_id", "first").distinct(), "kinds")
    equal = kinds.filter("doc_id != first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))

    texts = chosen.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    met = durable(_meetings(texts, shared, least), "met")
    near = durable(_hub_pairs(met, kinds), "near")
    links = durable(verified(texts, near.filter("likely"), shared).unionByName(equal), "links")
    found = durable(components(links, "a", "b"), "component")
    family = durable(components(near.select("a", "b").unionByName(links), "a", "b"), "component")
    more = verified(texts, _open_pairs(met, kinds, found, family), shared)
    component = components(links.unionByName(more), "a", "b")
    return (rows.join(component, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))


def one_per_component(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without those that are linked to one with a smaller id.

    Rows with a NULL id stay, and so do repeated rows of an id that stays.
    """
    gone = free_name(docs, "_dropped")
    dropped = linked_components(docs, text, key).filter("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col(key).cast("long") == F.col(gone), "left_anti")
