"""Jaccard join of documents over word shingles: blocked counting of columns, then a prefix-filter join whose pairs are each
verified by intersection, in place of a sparse product of the incidence matrix with its transpose that adds up counts.

Columns (shingles) are dealt into blocks by their hash. A block first counts its columns; only entries in columns of two
or more rows can add to a product and go on. A row with fewer such entries than its size demands (a partner must share
85 % of it, say) meets nobody. The others, one for each different set, bring their rarest entries, as many as a partner
cannot avoid altogether. A join on these columns names the pairs; sizes and the columns that are left bound what a pair may share
and discard most; for the others the whole lists of entries are intersected.

Groups are joined without all of their pairs: in each round the rows of a column meet a few of them as hubs and components
are found; in the end all pairs across components remain, so no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, batches_of, in_parts, mark, mix, shared_dir, utf8, word_hashes, written
from .components import components

#: Entries that a mapper gathers (with fewer than 2**16 documents), and entries that a block is planned for.
GATHER, BLOCK = 2_000_000, 3_000_000
#: Counts of a column above this sort alike.
MOST = (1 << 15) - 1
#: A column is common that a SHARE-th of the documents of a sample of about SAMPLE of them have, and LEAST of them. There are at
#: most SHARE times as many of these as a document has columns. Which ones are found changes who counts them, not results.
SAMPLE, SHARE, LEAST = 1 << 15, 512, 32
#: Hubs of a column in a round; rounds before all pairs across components, unless these fall to so many an entry.
HUBS, ROUNDS, WORTH = 4, 8, 2
_ENTRIES = "uid long, doc_id long, mark long, n long, set1 long, set2 long, entries array<long>"
#: What a block holds of the documents that are at home in it, and of all that have entries there.
_HOME = (("uid", "<i8"), ("doc", "<i8"), ("mark", "<i8"), ("null", "u1"), ("n", "<i8"), ("set1", "<u8"), ("set2", "<u8"))


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's k-word shingles, with repeats, and their documents; with fewer words, of all of them."""
    n = np.diff(at)
    size = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    document = np.repeat(np.arange(len(n)), size)
    first = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(document))
    last = at[1:][document]
    out = np.zeros(len(document), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            inside = first + j < last
            value = words[np.minimum(first + j, max(len(words) - 1, 0))] if len(words) else np.zeros(0, np.uint64)
            out = (out ^ np.where(inside, value, np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mix(out), document


def _tallied(k: int):
    """Columns of a sample's documents, and in how many of a flush's documents each stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, document = shingles(*word_hashes(*utf8(batch.column("text"))), k)
            key = np.unique((key >> np.uint64(16)) | (document.astype(np.uint64) << np.uint64(48)))
            column, n = np.unique((key & np.uint64((1 << 48) - 1)).view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(column[n > 1]), pa.array(n[n > 1])], names=["column", "n"])

    return run


def _common_columns(rows: DataFrame, k: int, n: int) -> np.ndarray:
    """The common columns, in order: so few at any size that mappers may know them. Documents that have them are dealt by
    themselves, so that such a column isn't gathered in its block."""
    part = 1 << 20
    some = rows.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(part)) < min(part, -(-SAMPLE * part // max(n, 1))))
    tallied = some.select("text").mapInArrow(in_parts(_tallied(k), 1 << 16), "column long, n long").groupBy("column").agg(F.sum("n").alias("n"))
    with batches_of(rows.sparkSession, BATCH_ROWS):
        found = tallied.where(F.col("n") >= max(LEAST, min(n, SAMPLE) // SHARE)).select("column").collect()
    return np.sort(np.array([r[0] for r in found], np.uint64))


def _blobs(k: int, blocks: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            key = np.concatenate([p[0] + (np.uint64(base) << np.uint64(48)) for p, base in zip(parts, np.cumsum([0] + [len(p[1]) for p in parts[:-1]]), strict=True)])
            uid, doc, mark, null = (np.concatenate([p[j] for p in parts]) for j in (1, 2, 3, 4))
            key.sort()
            if len(key):
                key = key[np.append(True, key[1:] != key[:-1])]
            document = (key >> np.uint64(48)).astype(np.int64)
            key &= np.uint64((1 << 48) - 1)
            n = np.bincount(document, minlength=len(uid))
            first = np.zeros(len(uid), np.uint64)
            second = np.zeros(len(uid), np.uint64)
            have = np.flatnonzero(n)
            if len(key):
                heads = np.searchsorted(document, have)
                first[have] = np.add.reduceat(mix(key), heads)
                second[have] = np.add.reduceat(mix(key ^ np.uint64(0xA5A5A5A5A5A5)), heads)
            # entries in common columns go with the document: their columns count as the most frequent
            own_key, own_document = key[:0], document[:0]
            if len(common):
                known = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key
                own_key, own_document, key, document = key[known], document[known], key[~known], document[~known]
            own_at = np.searchsorted(own_document, np.arange(len(uid) + 1))
            own_key = (own_key | (np.uint64(MOST) << np.uint64(48))).astype("<u8")
            block = (key % np.uint64(blocks)).astype(np.int64 if blocks > 1 << 15 else np.int16)
            order = np.argsort(block, kind="stable")
            cut = np.searchsorted(block[order], np.arange(blocks + 1))
            home = uid % blocks
            about = {"uid": uid, "doc": doc, "mark": mark, "null": null, "n": n, "set1": first, "set2": second}
            rows = ([], [])
            for b in range(blocks):
                mine = order[cut[b] : cut[b + 1]]
                d = document[mine]
                own = np.flatnonzero(home == b)
                if len(d) or len(own):
                    docs = np.unique(d)
                    count = np.bincount(np.searchsorted(docs, d), minlength=len(docs)).astype("<u4")
                    six = key[mine].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    rows[0].append(b)
                    held = np.diff(own_at)[own]
                    mine = np.repeat(own_at[own] - np.cumsum(held) + held, held) + np.arange(int(held.sum()))
                    rows[1].append(b"".join((np.array([len(own), len(mine), len(docs)], "<i8").tobytes(), *(about[k][own].astype(t).tobytes() for k, t in _HOME), held.astype("<i4").tobytes(), own_key[mine].tobytes(), uid[docs].tobytes(), count.tobytes(), six.tobytes())))
            for j in range(0, len(rows[0]), 8):
                yield pa.RecordBatch.from_arrays([pa.array(rows[0][j : j + 8], pa.int32()), pa.array(rows[1][j : j + 8], pa.binary())], names=["block", "blob"])

        parts, held, docs = [], 0, 0
        for batch in batches:
            words, at = word_hashes(*utf8(batch.column("text")))
            key, document = shingles(words, at, k)
            ids = batch.column("doc_id")
            uid, doc, mark, null = np.asarray(batch.column("uid")), np.asarray(ids.fill_null(0)), np.asarray(batch.column("mark")), np.asarray(ids.is_null()).astype(np.uint8)
            for begin in range(0, len(uid), 1 << 15):  # 16 bits number a flush's documents
                rows = slice(begin, begin + (1 << 15))
                if docs + len(uid[rows]) > 1 << 16:
                    yield from flush(parts)
                    parts, held, docs = [], 0, 0
                mine = slice(*np.searchsorted(document, [begin, begin + (1 << 15)]))
                parts.append(((key[mine] >> np.uint64(16)) + ((document[mine] - begin).astype(np.uint64) << np.uint64(48)), uid[rows], doc[rows], mark[rows], null[rows]))
                held, docs = held + len(parts[-1][0]), docs + len(uid[rows])
            if held >= GATHER:
                yield from flush(parts)
                parts, held, docs = [], 0, 0
        if parts:
            yield from flush(parts)

    return run


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    """Entries of a block in columns of two or more rows, by document; the rarest columns sort first."""
    homes, commons, got, documents = [], [], [], 0
    for blob in rows.column("blob"):
        raw = blob.as_py()
        at = 24

        def field(kind: str, m: int) -> np.ndarray:
            nonlocal at
            at += m * np.dtype(kind).itemsize
            return np.frombuffer(raw, kind, m, at - m * np.dtype(kind).itemsize)

        own, inside, m = np.frombuffer(raw, "<i8", 3).tolist()
        homes.append([field(kind, own) for _, kind in _HOME])
        commons.append((field("<i4", own), field("<i8", inside)))
        uid, count = field("<i8", m), field("<u4", m)
        six = np.frombuffer(raw, np.uint8, -1, at).reshape(-1, 6)
        wide = np.zeros((len(six), 8), np.uint8)
        wide[:, :6] = six
        got.append((uid, np.repeat(np.arange(m, dtype=np.int32) + documents, count), wide.view("<i8").ravel()))
        documents += m
    uid, document, entry = (np.concatenate([g[j] for g in got]) for j in range(3))
    home = {name: np.concatenate([h[j] for h in homes]) for j, (name, _) in enumerate(_HOME)}
    del got, homes
    order = np.argsort(entry)
    sorted_ = entry[order]
    heads = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
    count = np.diff(np.append(heads, len(sorted_)))
    many = np.repeat(count >= 2, count)
    keep = order[many]
    value = (np.minimum(np.repeat(count, count)[many], MOST) << 48) | sorted_[many]
    del order, sorted_, many
    document = document[keep]
    order = np.argsort(document, kind="stable")
    document, value = document[order], value[order]
    shown, first = np.unique(document, return_index=True)
    offsets = np.append(first, len(value)).astype(np.int32)
    # rows at home here say what they are, with their entries in common columns; the others only have entries
    n, m = len(home["uid"]), len(shown)
    told = lambda name, mask=None: pa.array(np.append(home[name].view(np.int64), np.zeros(m, np.int64)), mask=np.append(np.zeros(n, bool) if mask is None else mask, np.ones(m, bool)))
    inside, common = (np.concatenate([c[j] for c in commons]) for j in range(2))
    places = np.concatenate([[0], np.cumsum(inside), offsets[1:] + len(common)]).astype(np.int32)
    entries = pa.ListArray.from_arrays(pa.array(places), pa.array(np.append(common, value)))
    return pa.table({"uid": pa.array(np.append(home["uid"], uid[shown])), "doc_id": told("doc", home["null"] > 0), "mark": told("mark"), "n": told("n"), "set1": told("set1"), "set2": told("set2"), "entries": entries})


def _linked(na: Column, nb: Column, overlap: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (na + nb - overlap)


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """uid, doc_id, mark, n_shingles, component_id, first for each row of `documents` (doc_id, text; other columns are not
    read). A row's set is its distinct k-word shingles (lower-cased A-Z, words between white space); with fewer words, all
    of them as one; null and blank texts have an empty set and meet nobody. Two rows link when `percent` of their union
    is shared; component_id is the smallest doc_id reachable by links. Rows with equal ids stay apart (uid tells them
    apart in this result alone, common.mark of the text in any table); null ids come last and never name a component that has another. `first` marks one row of each
    component: the smallest doc_id's, then the smallest uid's."""
    spark = documents.sparkSession
    folder = shared_dir(spark)
    rows = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark(F.col("text")).alias("mark"))
    # words are at least a byte and a space, so this bounds a block's entries
    letters, n_rows = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    blocks = int(max(48, (letters or 0) // (7 * BLOCK)))
    blobs = rows.mapInArrow(in_parts(_blobs(k, blocks, _common_columns(rows, k, n_rows))), "block int, blob binary")
    entries = blobs.groupBy("block").applyInArrow(_block, _ENTRIES)
    whole = [F.first(c, ignorenulls=True).alias(c) for c in ("doc_id", "mark", "n", "set1", "set2")]
    all_rows = entries.groupBy("uid").agg(*whole, F.flatten(F.collect_list("entries")).alias("entries"))
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    fit = (F.size("entries") >= need) & (F.col("n") > 0)
    with batches_of(spark, BATCH_ROWS):
        kept = written(all_rows.select("uid", "doc_id", "mark", "n", "set1", "set2", F.when(fit, F.array_sort("entries")).alias("entries")), f"{folder}/rows")
    fits = kept.where(F.col("entries").isNotNull())
    same = ["n", "set1", "set2"]
    classes = written(fits.groupBy(*same).agg(F.min("uid").alias("c")), f"{folder}/classes")
    sets = written(fits.join(classes.select(F.col("c").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("c"), "n", "entries", (F.size("entries") - need + 1).alias("prefix")), f"{folder}/sets")
    # rest: entries from this one on; a pair whose first common column this is shares no more
    posted = written(sets.select("c", "n", F.size("entries").alias("m"), (F.col("n") - F.size("entries")).alias("own"), F.posexplode(F.slice("entries", F.lit(1), F.col("prefix"))).alias("at", "column")).select("c", "n", "own", "column", (F.col("m") - F.col("at")).alias("rest")), f"{folder}/posted")

    def able() -> Column:
        """Whether two rows that meet in a column may share enough, by their sizes and what is left of their entries."""
        return _linked(F.col("na"), F.col("nb"), F.least("na", "nb", "ra", "rb"), percent)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Links among (a, na, b, nb), which may repeat."""
        left = sets.select(F.col("c").alias("a"), F.col("entries").alias("ea"))
        right = sets.select(F.col("c").alias("b"), F.col("entries").alias("eb"))
        both = pairs.select("a", "na", "b", "nb").distinct().join(left, "a").join(right, "b")
        overlap = F.size(F.array_intersect("ea", "eb"))
        return written(both.where(_linked(F.col("na"), F.col("nb"), overlap, percent)).select("a", "b"), f"{folder}/{name}")

    links, labelled, before = None, posted.withColumn("root", F.col("c")), 0
    for turn in range(ROUNDS + 1):
        by_root = labelled.groupBy("column", "root").count().groupBy("column").agg(F.sum("count").alias("n_rows"), F.sum(F.col("count") * F.col("count")).alias("within"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        pairs_left, rows_left = (int(x or 0) for x in by_root.agg(F.sum((F.col("n_rows") * F.col("n_rows") - F.col("within")) / 2), F.sum("n_rows")).first())
        if not pairs_left:
            break
        open_ = labelled.join(by_root.select("column"), "column", "left_semi")
        last = pairs_left <= WORTH * rows_left or turn == ROUNDS or turn > 1 and pairs_left > 0.95 * before
        before = pairs_left
        one = open_.select("column", F.col("c").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("root").alias("root_a"))
        if last:
            two = open_.select("column", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("root").alias("root_b"))
            pairs = one.join(two, "column").where((F.col("root_a") < F.col("root_b")) & able())
        else:
            # first rows with the fewest entries of their own, as what others were copied from; then any, for each column others
            order = [F.col("own")] * (turn == 0) + [F.xxhash64("c", "column", F.lit(turn))]
            lot = F.pmod(F.xxhash64("c", F.lit(turn)), F.lit(HUBS))
            hub = open_.groupBy("column", lot.alias("lot")).agg(F.min(F.struct(*order, F.col("c").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("root").alias("root_b"))).alias("hub"))
            pairs = one.join(hub.select("column", "hub.b", "hub.nb", "hub.rb", "hub.root_b"), "column").where((F.col("root_a") != F.col("root_b")) & able())
        found = verified(pairs, f"links-{turn}")
        links = found if links is None else links.unionByName(found)
        roots = components(links, f"{folder}/turn-{turn}")
        links = roots.select(F.col("u").alias("a"), F.col("v").alias("b"))
        if last:
            break
        labelled = written(posted.join(roots.withColumnRenamed("u", "c"), "c", "left").select("c", "n", "own", "column", "rest", F.coalesce("v", "c").alias("root")), f"{folder}/labelled-{turn}")
    grouped = fits.select("uid", "doc_id", *same).join(classes, same).select("uid", "doc_id", "c")
    if links is not None:
        grouped = grouped.join(links.select(F.col("a").alias("c"), F.col("b").alias("root")), "c", "left").select("uid", "doc_id", F.coalesce("root", "c").alias("root"))
    else:
        grouped = grouped.withColumnRenamed("c", "root")
    # as tables of their own, so that a component of very many rows is split by the join
    grouped = written(grouped, f"{folder}/grouped")
    least = written(grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("least")), f"{folder}/least")
    named = grouped.join(least, "root").select("uid", F.col("least.doc_id").alias("component_id"), (F.col("least.uid") == F.col("uid")).alias("first"))
    return kept.select("uid", "doc_id", "mark", F.col("n").alias("n_shingles")).join(named, "uid", "left").select("uid", "doc_id", "mark", "n_shingles", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))


def oracle(k: int = 4, percent: int = 85) -> str:
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, least(len(w), 1)) + 1)) AS i FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {percent} * (x.n + y.n - o)),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.b FROM r JOIN e ON e.a = r.v),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.u = d.doc_id
"""
