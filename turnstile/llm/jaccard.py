"""Exact n-gram Jaccard join by prefix filters under several global token orders.

A document is its set of distinct word shingles.  If two sets have a Jaccard
similarity of ``percent`` or more, then under *any* global order of the tokens
their prefixes (the first ``n - ceil(percent * n) + 1`` tokens) share a token.

1. Classes: equal sets (128-bit set hash and size) are one class; its smallest
   id represents it, so exact copies never meet.
2. First order, rare tokens first: tokens that many documents share are
   listed (bounded list, broadcast) and ranked last; the rest follow their
   hash.  The list only shapes the order: any order gives whole results.  All
   documents that share a prefix token meet in the cell named by the smallest
   id with that token, so a document joins a cell once, not once per token or
   per pair.
   Cells and documents that cannot hold a link by size and by the place of
   the first shared prefix token are dropped before any set is fetched.
3. Further orders (hash permutations): if two sets overlap in ``a`` tokens, their first ``n - a + l`` tokens under any
   order have ``l`` in common.  So each document brings to its cells only its first tokens under these orders, as 4-byte
   codes (about 2 bytes a token of its text instead of 8), and a pair of a cell stays a candidate if it has enough codes
   in common under *every* order for its two sizes.  Equal codes of different tokens only let more pairs through.
   A group returns a spanning forest of its candidates, so rows out are linear in rows in.
4. Candidate groups (components of the candidate pairs) don't overlap, so the full set of each document that is left
   moves once.  Groups are cut into blocks of bounded bytes and rows; a block gets the group's smallest document beside
   its own rows and verifies its pairs on the full sets.  Only rows of larger groups that end up without a link to the
   smallest document are then compared with the other blocks.
5. Components of the verified links, by star contraction.

Null, empty or wordless texts have the empty set and no links.  Fewer words
than a shingle: the whole sequence is the only token.  Rows that share an id
are linked to each other.  A row without an id gets its class's component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import words as W
from .graph import components

SHINGLE, PERCENT = 5, 80
# Length of the broadcast list of frequent tokens (16 bytes each), and the count that makes a token frequent.
FREQUENT_TOKENS, FREQUENT_FROM = 1 << 19, 4
FLUSH_TOKENS = 1 << 21
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 512
# Orders beyond the first one, and by how much of a set the prefix of each is longer than it must be (1 / EXTRA).
ORDERS, EXTRA = (1, 2), 10
# Rows of at most five 8-byte numbers: 20 MB.
BROADCAST_ROWS = 1 << 18


def _sets(words: W.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, doc, first) of the distinct shingles of each text, sorted by (doc, token)."""
    h, counts = words.hashes(), words.counts
    token, at = W.ngrams(h, words.doc, k)
    tokens, docs = [token], [words.doc[at]]
    for n in sorted({int(c) for c in counts if 0 < c < k}):
        token, at = W.ngrams(h, words.doc, n)
        whole = counts[words.doc[at]] == n
        tokens.append(token[whole])
        docs.append(words.doc[at][whole])
    token, doc = np.concatenate(tokens), np.concatenate(docs)
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, doc, np.searchsorted(doc, np.arange(words.n_docs + 1))


def prefix_length(n, percent: int):
    """n - ceil(percent / 100 * n) + 1; works on arrays."""
    return n - (percent * n + 99) // 100 + 1


def frequent_tokens(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, count), sorted by token, of tokens that are frequent by the counts of each task.

    A task reports the tokens it met in two documents or more of a run; the sums of these decide.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep, held, size = W.space_separators(), [], 0

        def flush() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            often = count > 1
            return pa.RecordBatch.from_arrays([pa.array(W.signed(token[often])), pa.array(count[often], pa.int64())],
                                              ["token", "n"])

        for batch in batches:
            for _, _, words in W.chunks(batch.column(0), sep, True):
                held.append(_sets(words, k)[0])
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = docs.select(text_col).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = materialize(counted.where(F.col("n") >= FREQUENT_FROM), "jaccard-frequent")
    found = W.most_frequent(counted, FREQUENT_TOKENS).toArrow()
    token, count = W.unsigned(found["token"].to_numpy()), found["n"].to_numpy()
    order = np.argsort(token)
    return token[order], count[order]


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """id, n, f1, f2 (set hash) and the prefix under the first order of every row."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, id_col, text_col, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = W.space_separators()
        listed, count = frequent.value
        for batch in batches:
            for lo, hi, words in W.chunks(batch.column(1), sep, True):
                token, doc, first = _sets(words, k)
                n = np.diff(first)
                sums = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
                some = n > 0
                if len(token):
                    for out, seed in zip(sums, (1, 2)):
                        out[some] = np.add.reduceat(W.mix(token + np.uint64(seed)), first[:-1][some])
                if len(listed) and len(token):
                    at = np.minimum(np.searchsorted(listed, token), len(listed) - 1)
                    rank = np.where(listed[at] == token, count[at], 0)
                    order = np.lexsort((token, rank, doc))
                    token = token[order]
                keep = np.arange(len(token)) - first[doc] < prefix_length(n, percent)[doc]
                kept = np.concatenate([[0], np.cumsum(keep)])
                prefix = pa.ListArray.from_arrays(pa.array(kept[first].astype(np.int32)), pa.array(W.signed(token[keep])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(W.signed(sums[0])),
                     pa.array(W.signed(sums[1])), prefix], ["id", "n", "f1", "f2", "prefix"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(
        run, "id long, n long, f1 long, f2 long, prefix array<long>")


def _full_sets(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = W.space_separators()
        for batch in batches:
            for lo, hi, words in W.chunks(batch.column(1), sep, True):
                token, _, first = _sets(words, k)
                sets = [token[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())],
                                                 ["id", "tokens"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, tokens binary")


def code_length(n, percent: int):
    """Tokens of a set whose codes are kept under each further order; works on arrays."""
    return np.minimum(prefix_length(n, percent) + n // EXTRA, n)


def common_codes(n, m, percent: int):
    """Codes that two sets of n and m tokens have in common if they are linked (at least; below 1 counts as 1)."""
    overlap = -(-percent * (n + m) // (100 + percent))
    unseen = np.maximum(n - code_length(n, percent), m - code_length(m, percent))
    return np.maximum(overlap - unseen, 1)


def _codes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """id, n and, one order after the other, the codes of the first tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = W.space_separators()
        for batch in batches:
            for lo, hi, words in W.chunks(batch.column(1), sep, True):
                token, doc, first = _sets(words, k)
                n = np.diff(first)
                keep = np.arange(len(token)) - first[doc] < code_length(n, percent)[doc]
                parts = []
                for seed in ORDERS:
                    mixed = W.mix(token ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                    mixed = mixed[np.lexsort((mixed, doc))]
                    parts.append((mixed[keep] >> np.uint64(32)).astype("<u4"))
                at = np.concatenate([[0], np.cumsum(code_length(n, percent))])
                codes = [b"".join([p[a:b].tobytes() for p in parts]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()),
                                                  pa.array(codes, pa.binary())], ["id", "n", "codes"])

    return docs.mapInArrow(run, "id long, n long, codes binary")


class _Postings:
    """Members by token code, for counting shared tokens of one member with all others."""

    def __init__(self, lists: list[np.ndarray]):
        _, code = np.unique(np.concatenate(lists), return_inverse=True)
        first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        self.own = [code[a:b] for a, b in zip(first[:-1], first[1:])]
        member = np.repeat(np.arange(len(lists)), np.diff(first))
        order = np.argsort(code, kind="stable")
        self.member = member[order]
        self.at = np.searchsorted(code[order], np.arange(int(code.max(initial=-1)) + 2))
        self.n_members = len(lists)

    def shared(self, x: int) -> np.ndarray:
        """Tokens that member x has in common with each member."""
        codes = self.own[x]
        begin, size = self.at[codes], self.at[codes + 1] - self.at[codes]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        return np.bincount(self.member[place], minlength=self.n_members)


def _forest(ids: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int, related) -> list[tuple[int, int]]:
    """Spanning forest of the pairs for which ``related(x, others)`` holds (of different sides, if there are two)."""
    two = side.min() != side.max()
    group, edges = np.arange(len(ids)), []
    for x in np.argsort(n, kind="stable").tolist():
        near = np.flatnonzero((group != group[x]) & (100 * n >= percent * n[x]) & (percent * n <= 100 * n[x])
                              & (side != side[x] if two else True))
        if not len(near):
            continue
        for y in related(x, near).tolist():
            if group[y] != group[x]:
                edges.append((int(ids[x]), int(ids[y])))
                group[group == group[y]] = group[x]
    return edges


def _candidates(ids: np.ndarray, n: np.ndarray, side: np.ndarray, codes: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Candidates under all further orders."""
    length = code_length(n, percent)
    postings = [_Postings([np.frombuffer(c, "<u4", w, 4 * o * w) for c, w in zip(codes, length.tolist())]) for o in range(len(ORDERS))]

    def related(x: int, near: np.ndarray) -> np.ndarray:
        need = common_codes(n[x], n[near], percent)
        for p in postings:
            enough = p.shared(x)[near] >= need
            near, need = near[enough], need[enough]
            if not len(near):
                break
        return near

    return _forest(ids, n, side, percent, related)


def _links(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs that reach the similarity, on the full sets."""
    n = np.array([len(s) for s in sets])
    postings = None

    def related(x: int, near: np.ndarray) -> np.ndarray:
        nonlocal postings
        if len(near) > 4:
            postings = postings or _Postings(sets)
            both = postings.shared(x)[near]
        else:
            both = np.array([np.isin(sets[x], sets[y], assume_unique=True).sum() for y in near])
        return near[100 * both >= percent * (n[x] + n[near] - both)]

    return _forest(ids, n, side, percent, related)


def _pairs(edges: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([a for a, _ in edges], pa.int64()), "v": pa.array([b for _, b in edges], pa.int64())})


def _cell_candidates(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        if len(table) < 2:
            return _pairs([])
        return _pairs(_candidates(*(table[c].to_numpy() for c in ("id", "n", "side")), table["codes"].to_pylist(), percent))
    return run


def _cell_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        if len(table) < 2:
            return _pairs([])
        sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
        return _pairs(_links(table["id"].to_numpy(), table["side"].to_numpy(), sets, percent))
    return run


def _block_count(members: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """Blocks (``nb``) that the members of each group need, by bytes and rows."""
    return (members.join(sizes, "id").groupBy(by)
            .agg(F.greatest(F.ceil(F.sum("bytes") / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).alias("nb")))


def _block_of(nb: str = "nb"):
    return F.pmod(F.xxhash64("id"), F.col(nb))


def candidate_pairs(rows: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (u, v) that connect the candidates of each cell; ``members`` is (cell, id)."""
    active = materialize(members.select("id").distinct(), "jaccard-active")
    codes = materialize(_codes(rows.join(_checked(active), "id", "left_semi").select("id", "text"), k, percent), "jaccard-codes")
    size = codes.groupBy("id").agg(F.sum(F.octet_length("codes")).alias("bytes"))
    placed = (members.join(_block_count(members, size, "cell"), "cell").withColumn("side", _block_of())
              .select("cell", "id", "side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("other"))
              .select("cell", "id", "side", F.least("side", "other").alias("b0"), F.greatest("side", "other").alias("b1")))
    placed = _checked(materialize(placed, "jaccard-placed"))
    return codes.join(placed, "id").groupBy("cell", "b0", "b1").applyInArrow(_cell_candidates(percent), "u long, v long")


def verified_links(rows: DataFrame, groups: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) that connect the linked documents of each group; ``groups`` is (group, id), the group named by its
    smallest id."""
    groups = materialize(groups, "jaccard-groups")
    wanted = _checked(groups.select("id"))
    sets = materialize(_full_sets(rows.join(wanted, "id", "left_semi"), "id", "text", k), "jaccard-sets")
    size = sets.groupBy("id").agg(F.sum(F.octet_length("tokens")).alias("bytes"), F.count(F.lit(1)).alias("sets"))
    placed = materialize(groups.join(_block_count(groups, size, "group"), "group").withColumn("block", _block_of()), "jaccard-blocks")
    hubs = (placed.where("id = group and nb > 1").withColumnRenamed("block", "home")
            .select("group", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("block"), "home")
            .where("block <> home").select("group", "id", "block"))
    first = _checked(placed.select("group", "id", "block").unionByName(hubs))
    near = materialize(sets.join(first, "id").select("group", "block", "id", F.lit(0).alias("side"), "tokens")
                       .groupBy("group", "block").applyInArrow(_cell_links(percent), "u long, v long"), "jaccard-links")
    large = placed.where("nb > 1")
    if large.isEmpty():
        return near
    # rows of large groups that aren't connected with the group's smallest document through their own block
    inside = near.join(_checked(large.select(F.col("id").alias("u"), "group")), "u").select("u", "v")
    root = components(inside)
    linked = root.select(F.col("u").alias("id"), F.col("v").alias("group"))
    again = large.join(size.where("sets > 1"), "id", "left_semi")          # an id with several texts: any of them may be apart
    rest = materialize(large.where("id <> group").join(linked, ["id", "group"], "left_anti").unionByName(again).distinct(), "jaccard-rest")
    if rest.isEmpty():
        return near
    blocks = _block_count(rest.select("group", "id"), size, "group").withColumnRenamed("nb", "nr")
    mine = (rest.select("group", "id", "nb").join(blocks, "group").withColumn("r", _block_of("nr"))
            .select("group", "id", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("block"), F.lit(0).alias("side")))
    other = (large.join(blocks, "group")
             .select("group", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1)).alias("r"), "block", F.lit(1).alias("side")))
    far = (sets.join(_checked(materialize(mine.unionByName(other.select(*mine.columns)), "jaccard-far")), "id")
           .groupBy("group", "r", "block").applyInArrow(_cell_links(percent), "u long, v long"))
    return near.unionByName(far)


def _possible(met: DataFrame, percent: int) -> DataFrame:
    """The rows (cell, id, n, first) that can have a partner in their cell, by sizes and token positions.

    Linked sets share their first common token inside both prefixes, and in its cell it lies at ``first`` (the first
    place of the set's tokens of this cell) or behind, in either set.  So each of the two shares at most its tokens
    from ``first`` on; this bounds the size of a partner by ``most``.  The smaller of the two has ``most`` >= the size
    of the larger >= its own: a *strong* set.  So a cell needs one, and the others of the cell must be within reach of
    its strong sets.
    """
    sized = met.withColumn("most", F.floor((F.col("n") - F.col("first")) * (100 + percent) / percent - F.col("n")))
    strong = F.col("most") >= F.col("n")
    reach = F.least("most", F.floor(F.col("n") * 100 / percent))
    cells = (sized.groupBy("cell").agg(F.min(F.when(strong, F.col("n"))).alias("low"),
                                       F.max(F.when(strong, reach)).alias("high"), F.count(F.lit(1)).alias("c"))
             .where("low is not null and c > 1"))
    return (sized.join(cells, "cell").where("n >= low and n <= high and most >= low")
            .select("cell", "id", "n", "first"))


def _without_contained(members: DataFrame) -> DataFrame:
    """Drop cells whose rows all lie in one other cell, which then sees all their pairs.

    The other cell is the smallest that holds the cell's name as a document; in a group of near copies nearly all
    cells are contained in the one of the smallest id, so a document is fetched for about one cell.
    """
    cells = members.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    parent = (members.join(cells.select(F.col("cell").alias("id")), "id").groupBy(F.col("id").alias("cell"))
              .agg(F.min("cell").alias("parent")).where("parent < cell"))
    there = members.select(F.col("cell").alias("parent"), "id")
    inside = members.join(parent, "cell").join(there, ["parent", "id"]).groupBy("cell").agg(F.count(F.lit(1)).alias("common"))
    contained = inside.join(cells, "cell").where("common = rows").select("cell")
    return members.join(contained, "cell", "left_anti")


def _checked(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers, hinted for broadcast if they are few by count; beyond that the join shuffles."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _same_id(copies: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) from an id with several sets to the representatives of these sets.

    Such an id is a copy in one class at least and appears in another one, as a copy or as its representative.
    """
    ids = _checked(copies.select("id").distinct())
    places = copies.select("id", "f1", "f2", "n").distinct().select("id").unionByName(
        classes.select(F.col("rep").alias("id")).join(ids, "id", "left_semi"))
    several = places.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    return copies.join(several, "id", "left_semi").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                       percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, class_id (smallest id with an equal set), component_id."""
    sig = materialize(signatures(docs, id_col, text_col, k, percent), "jaccard-signatures")
    classes = materialize(sig.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")), "jaccard-classes")

    copies = materialize(sig.select("id", "f1", "f2", "n").join(classes, ["f1", "f2", "n"]).where("id <> rep"), "jaccard-copies")
    again = copies.select("id", "f1", "f2", "n").distinct()
    reps = sig.where("id is not null").join(_checked(again), ["id", "f1", "f2", "n"], "left_anti")
    postings = reps.select("id", "n", F.posexplode("prefix").alias("at", "token"))
    centers = postings.groupBy("token").agg(F.min("id").alias("cell"), F.count(F.lit(1)).alias("c")).where("c > 1")
    met = materialize(postings.join(centers.select("token", "cell"), "token")
                      .groupBy("cell", "id", "n").agg(F.min("at").alias("first")), "jaccard-cells")
    members = materialize(_possible(met, percent).select("cell", "id").distinct(), "jaccard-members")
    members = materialize(_without_contained(members), "jaccard-members")

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = components(candidate_pairs(rows, members, k, percent))
    groups = joined.select(F.col("v").alias("group"), F.col("u").alias("id")).unionByName(
        joined.select(F.col("v").alias("group"), F.col("v").alias("id")).distinct())
    links = verified_links(rows, groups, k, percent)

    root = components(links.unionByName(_same_id(copies, classes)))
    label = materialize(
        classes.join(root.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left")
        .select("f1", "f2", "n", "rep", F.coalesce("root", "rep").alias("root")), "jaccard-labels")
    return (sig.select("id", "n", "f1", "f2").join(label, ["f1", "f2", "n"], "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("rep", "id").alias("class_id"), F.coalesce("root", "id").alias("component_id")))


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that name their component; of rows that repeat an id, one."""
    named = found.where(F.col(id_col).isNotNull())
    gone = materialize(named.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "jaccard-gone")
    kept = docs.join(_checked(gone), id_col, "left_anti").select(*docs.columns)
    twice = named.groupBy(id_col).count().where("count > 1").select(id_col)
    if twice.isEmpty():
        return kept
    return (kept.join(twice, id_col, "left_anti").select(*docs.columns)
            .unionByName(kept.join(twice, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns)))
