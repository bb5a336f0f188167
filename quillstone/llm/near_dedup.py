"""Near-dedup of whole documents: five-word shingles, Jaccard similarity of 0.8 or more.

SimHash links (simhash.py, radius 2) find copies that differ very little. At a similarity
of 0.8 fingerprints differ by 3 to 14 bits, a radius at which the triangle bound prunes no
branch of a vantage-point tree (unrelated texts lie at 32 +- 4 bits), so further candidates
come from min-hash bands (16 bands of 4: at a similarity of 0.8 a pair shares no band with a
chance of 2e-4). Every candidate pair is verified on the exact
shingle sets of the whole texts; the verified links are joined to components and the
smallest id of each stays.

No bucket is expanded into pairs: its members are compared with a leader (first one drawn
by hash); those alike leave, and the one most like the leader leads the rest on, so that the
text that many copies were made from comes to lead. These first pairs are verified and joined
to groups. Then whole buckets, and SimHash groups as further buckets, are gone through in
pieces of bounded size: first for some pairs that may join two groups, then, when these are
verified and joined, for every candidate pair of texts that are still in different groups,
which is verified in its piece on the shingle sets themselves; a piece gives links that join its
groups, fewer than it has members, and never lists pairs. So no pair at or above CANDIDATE in a
bucket stays unverified unless its texts are joined already; the leaders only save work. The
comparisons of texts that stay apart are the square of their bucket. Null ids are never compared and
stay; rows that share an id stand or fall together; texts without words are alike; texts are
read whole, of any length; an empty table gives none. All columns of docs come back, whatever
their names but for _quill_*.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import ascii_lower, batches_of, discard, keep, sieve, words
from quillstone.llm.decontaminate import grams, inside, scramble
from quillstone.llm.graph import components
from quillstone.llm.simhash import group_prints, lists_of, majority, shingles, sliced

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Share of equal min-hashes from which a pair is verified (at a similarity of 0.8 fewer agree with a chance of 4e-4), and from which a member leaves the rounds of its bucket.
CANDIDATE, ALIKE = 0.62, 0.8
ROUNDS = 4
#: Members of a bucket in one side of a piece, and shingles of them, on average.
PIECE, PIECE_SHINGLES = 512, 1 << 20
SIGNATURE = BANDS * ROWS
#: Texts handed at once to the task that sketches them, and words that it works on at once, or one text.
SKETCH_TEXTS, SKETCH_WORDS = 1000, 1 << 15
_draw = np.random.default_rng(23)
XOR = _draw.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)
ODD = _draw.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) | np.uint64(1)


def row_shingles(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, laid end to end, with row starts; a short row has one shingle of all its words."""
    tokens = tokens.astype(np.uint64)
    lens = np.diff(starts)
    g = grams(tokens, SHINGLE)
    g = g[inside(starts, SHINGLE, len(g))]
    counts = np.maximum(lens - SHINGLE + 1, 1)
    out_starts = np.r_[0, np.cumsum(counts)]
    out = np.empty(out_starts[-1], np.uint64)
    short = np.flatnonzero(lens < SHINGLE)
    is_short = np.zeros(len(out), bool)
    is_short[out_starts[short]] = True
    out[~is_short] = g
    for r in short:
        t = tokens[starts[r] : starts[r + 1]]
        out[out_starts[r]] = grams(t, len(t))[0] + np.uint64(len(t)) if len(t) else np.uint64(0x1234)
    return out, out_starts


def signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Min-hash signature (rows x SIGNATURE, 32 bits each)."""
    out = np.empty((len(starts) - 1, SIGNATURE), np.uint32)
    for j in range(SIGNATURE):
        out[:, j] = np.minimum.reduceat((((h ^ XOR[j]) * ODD[j]) >> np.uint64(32)).astype(np.uint32), starts[:-1])
    return out


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1, SKETCH_WORDS):
        h, starts = row_shingles(*lists_of(batch.column(1)))
        sig = signatures(h, starts)
        bands = np.zeros((len(sig), BANDS), np.uint64)
        for b in range(BANDS):
            for r in range(ROWS):
                bands[:, b] = scramble(bands[:, b] * np.uint64(31) + sig[:, b * ROWS + r].astype(np.uint64) + np.uint64(b + 1))
        at = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * SIGNATURE)
        ends = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(majority(h.view(np.int64), starts), pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(sig.view(np.int32).reshape(-1))),
                pa.ListArray.from_arrays(ends, pa.array(bands.view(np.int64).reshape(-1))),
            ],
            ["_id", "fp", "sig", "bands"],
        )


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    tokens = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.transform(words(ascii_lower(F.col(text_col))), lambda w: F.xxhash64(w)).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    return tokens.mapInArrow(_sketch_batches, f"_id {kind}, fp long, sig array<int>, bands array<long>")


def _agree(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(SIGNATURE))


def rest_links(sig: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs of rows that join groups of alike rows, and each row's best other candidate outside its group: few pairs a row, of one piece's rows."""
    m = len(sig)
    group = np.arange(m)
    best, partner = np.zeros(m), np.full(m, -1)
    a: list[int] = []
    b: list[int] = []
    for i in range(m):
        others = np.flatnonzero(group != group[i])
        if not len(others):
            break
        same = (sig[others] == sig[i]).mean(axis=1)
        near = others[same >= ALIKE]
        if len(near):
            _, first = np.unique(group[near], return_index=True)
            a += near[first].tolist()
            b += [i] * len(first)
            group[np.isin(group, group[near])] = group[i]
        better = (same >= CANDIDATE) & (same < ALIKE) & (same > best[others])
        best[others[better]], partner[others[better]] = same[better], i
    left = np.flatnonzero(partner >= 0)
    left = left[group[left] != group[partner[left]]]
    return a + left.tolist(), b + partner[left].tolist()


def cross_links(sig: np.ndarray, group: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that join the groups of all candidate pairs of the similarity or more; where rows are of two sides, of different sides.

    sets: sorted distinct shingles of each row. A pair whose groups are joined already is passed over.
    """
    two = len(np.unique(side)) > 1
    group, size = group.copy(), np.array([len(x) for x in sets])
    a: list[int] = []
    b: list[int] = []
    for i in range(len(sig)):
        others = np.arange(i + 1, len(sig))
        # No pair of such sizes can be as similar as asked.
        fits = np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i])
        others = others[fits & (group[others] != group[i]) & ((side[others] != side[i]) | (not two))]
        for j in others[(sig[others] == sig[i]).mean(axis=1) >= CANDIDATE] if len(others) else others:
            if group[i] == group[j]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common >= similarity * (size[i] + size[j] - common):
                a.append(int(j))
                b.append(i)
                group[group == group[j]] = group[i]
    return a, b


def _piece_pairs(kind: str, similarity: float | None):
    """Candidate pairs of a piece; with a similarity its verified links."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("_id").combine_chunks()
        order = np.array(sorted(range(len(ids)), key=lambda i: ids[i].as_py()))
        sig = np.asarray(table.column("sig").combine_chunks().flatten()).reshape(-1, SIGNATURE)[order]
        group = np.unique(table.column("root").combine_chunks().take(pa.array(order)).dictionary_encode().indices.to_numpy(), return_inverse=True)[1]
        if similarity is not None:
            values, starts = lists_of(table.column("s"))
            a, b = (np.array(x, np.int64) for x in cross_links(sig, group, table.column("slot").to_numpy()[order], [values[starts[i] : starts[i + 1]] for i in order], similarity))
        else:
            a, b = (np.array(x, np.int64) for x in rest_links(sig))
            apart = group[a] != group[b]
            a, b = a[apart], b[apart]
        return pa.table({"a": ids.take(pa.array(order[a], pa.int64())), "b": ids.take(pa.array(order[b], pa.int64()))})

    return run, f"a {kind}, b {kind}"


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def open_buckets(buckets: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets (key, _n) whose members are of several groups(node, root), and all members (key, _id, root) of buckets."""
    placed = buckets.join(groups.withColumnRenamed("node", "_id"), "_id", "left").withColumn("root", F.coalesce("root", "_id"))
    wide = placed.groupBy("key").agg(F.count("*").alias("_n"), F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high")
    return wide.select("key", "_n"), placed


def open_pairs(buckets: DataFrame, sig: DataFrame, groups: DataFrame, sets: DataFrame | None = None, similarity: float | None = None) -> DataFrame:
    """(a, b), a > b, of bucket members in different groups(node, root): some candidate pairs, as many as the members at most a few times over; with sets(_id, s) the links that join all groups.

    Members are dealt to slots and every two slots meet in a piece, so a bucket of any size takes many tasks.
    """
    wide, placed = open_buckets(buckets, groups)
    slots = F.ceil(F.col("_n") / F.lit(PIECE)).cast("int")
    facts = sig
    if sets is not None:
        facts = sig.join(sets.select("_id", "s"), "_id")
        # Very long texts make more slots, so that a piece of them is no larger in memory.
        held = placed.join(wide.select("key"), "key", "left_semi").join(sets.select("_id", F.size("s").alias("_s")), "_id").groupBy("key").agg(F.sum("_s").alias("_all"))
        wide = wide.join(held, "key")
        slots = F.greatest(slots, F.ceil(F.col("_all") / F.lit(PIECE_SHINGLES)).cast("int"))
    dealt = placed.join(wide.select("key", slots.alias("_slots")), "key").withColumn("slot", F.pmod(F.xxhash64("_id"), F.col("_slots")).cast("int"))
    dealt = dealt.join(facts, "_id").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1)))
    dealt = dealt.select("_id", "key", "root", "slot", "sig", *(["s"] if sets is not None else []), F.least("slot", "_other").alias("_i"), F.greatest("slot", "_other").alias("_j"))
    run, schema = _piece_pairs(sig.schema["_id"].dataType.simpleString(), similarity)
    return _ordered(dealt.groupBy("key", "_i", "_j").applyInArrow(run, schema))


def candidate_pairs(sk: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First pairs of ids to verify (a, b), a > b; buckets (_id, key); signatures of their members (_id, sig). sk(_id, fp, sig, bands)."""
    members = sk.select("_id", F.explode("bands").alias("key"))
    lead = members.groupBy("key").agg(F.min("_id").alias("lead"), F.max("_id").alias("_most")).filter("lead < _most")
    members = keep(members.join(lead.select("key"), "key", "left_semi").distinct(), "members")
    # Signatures of the members alone, written once, so that the joins below are plain ones that split where a leader is hot.
    prints = keep(group_prints(sk.select("_id", "fp")).select("_id", "component_id").distinct(), "prints")
    shared = prints.groupBy("component_id").count().filter("count > 1").select("component_id")
    prints = prints.join(shared, "component_id", "left_semi")
    buckets = members.unionByName(prints.select("_id", F.xxhash64("component_id", F.lit("simhash")).alias("key"))).distinct()
    # Bands with the same members are one bucket.
    alone = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("_id").alias("low"), F.max("_id").alias("high"), F.bit_xor(F.xxhash64("_id")).alias("x"), F.bit_xor(F.xxhash64("_id", F.lit(1))).alias("y"))
    alone = alone.groupBy("n", "low", "high", "x", "y").agg(F.min("key").alias("key")).select("key")
    buckets = keep(buckets.join(alone, "key", "left_semi"), "buckets")
    sig = keep(sk.select("_id", "sig").join(members.select("_id").unionByName(prints.select("_id")).distinct(), "_id", "left_semi").dropDuplicates(["_id"]), "signatures")
    found, left = None, members.count()
    first = left
    # Leaders differ from band to band, so that a text meets many of them.
    lead = members.groupBy("key").agg(F.min_by("_id", F.xxhash64("_id", "key")).alias("lead"))
    for _ in range(ROUNDS):
        if not left:
            break
        placed = members.join(lead, "key").filter("_id <> lead")
        pairs = placed.select("_id", "lead").distinct()
        pairs = pairs.join(sig, "_id").join(sig.select(F.col("_id").alias("lead"), F.col("sig").alias("sig2")), "lead")
        pairs = keep(pairs.select("_id", "lead", _agree("sig", "sig2").alias("agree")), "pairs")
        good = pairs.filter(F.col("agree") >= CANDIDATE).select(F.col("_id").alias("a"), F.col("lead").alias("b"))
        found = good if found is None else found.unionByName(good)
        placed = keep(placed.join(pairs, ["_id", "lead"]), "placed")
        alike = F.col("agree") >= ALIKE
        rest = placed.filter(~alike).select("_id", "key")
        # The bucket goes on under the member most like its leader; without one the least id left leads.
        heir = F.max(F.when(alike, F.struct("agree", "_id")))["_id"]
        lead = placed.groupBy("key").agg(F.coalesce(heir, F.min_by("_id", F.when(~alike, F.xxhash64("_id", "key")))).alias("lead"), F.count_if(~alike).alias("_n"), heir.isNull().cast("int").alias("_own"))
        lead = keep(lead.filter("_n > _own").select("key", "lead"), "leads")
        last, members = members, keep(rest.join(lead.select("key"), "key", "left_semi"), "members")
        discard(last, placed)
        left = members.count()
        if left <= 0.02 * first:
            break
    close = prints.filter("_id <> component_id").select(F.col("_id").alias("a"), F.col("component_id").alias("b"))
    found = close if found is None else found.unionByName(close)
    return _ordered(found), buckets, sig


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, s): sorted distinct shingle hashes of the whole texts of some ids(_id), kept."""
    ids = keep(ids.select("_id").distinct(), "ids")
    maybe = sieve(ids, "_id")
    asked = docs.filter(maybe(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id", "left_semi")
    asked = asked.select("_id", words(ascii_lower(F.col("_text"))).alias("_w"))
    return keep(asked.select("_id", F.array_sort(F.array_distinct(F.transform(shingles(F.col("_w"), SHINGLE), lambda s: F.xxhash64(s)))).alias("s")), "sets")


def verified_links(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """The pairs whose exact shingle sets reach the similarity."""
    ids = pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id")))
    sets = shingle_sets(docs, ids, id_col, text_col)
    both = pairs.join(sets.select(F.col("_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("_id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.filter((common >= F.lit(similarity) * union) | (union == 0)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) for every id of a group of two or more; root is the smallest id of the group."""
    with batches_of(docs.sparkSession, SKETCH_TEXTS):
        sk = keep(sketches(docs, id_col, text_col), "sketches")
    pairs, buckets, sig = candidate_pairs(sk)
    tried = keep(pairs, "pairs")
    links = keep(verified_links(docs, tried, id_col, text_col, similarity), "links")
    more = keep(open_pairs(buckets, sig, keep(components(links), "groups")).join(tried, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links = links.unionByName(keep(verified_links(docs, more, id_col, text_col, similarity), "links"))
    groups = keep(components(links), "groups")
    wide, placed = open_buckets(buckets, groups)
    members = keep(placed.join(wide, "key", "left_semi").select("_id").distinct(), "members")
    if not members.isEmpty():
        # Each row of an id is a member with its own text.
        sets = shingle_sets(docs, members, id_col, text_col)
        last = keep(open_pairs(buckets, sig, groups, sets, similarity), "links")
        links = links.unionByName(last.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return components(links)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs without near-duplicates: of each group the row(s) with the smallest id stay."""
    lost = near_duplicate_groups(docs, id_col, text_col, similarity).filter("node <> root").select(F.col("node").alias("_quill_id")).distinct()
    lost = keep(lost, "lost")
    marked = docs.withColumn("_quill_maybe", sieve(lost, "_quill_id")(F.col(id_col)))
    # Only rows that the sieve holds back are shuffled.
    kept = marked.filter("_quill_maybe").join(lost, F.col(id_col) == F.col("_quill_id"), "left_anti")
    return marked.filter("NOT _quill_maybe").unionByName(kept).select(docs.columns)
