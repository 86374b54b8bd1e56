"""Removal of repeated passages by de Bruijn compaction (operator 3).

Every window of k words is an edge of a de Bruijn graph over the corpus. Edges are stored by the chain: consecutive
windows that share a minimizer (the least hash among the window's m-word grams) are one super-k-mer, told by its
minimizer and by the hash of its words. A window that occurs twice has the same minimizer both times, so only chains
whose minimizer occurs twice are looked at again: equal chains are repeated as a whole, and chains that share a
minimizer but differ are compared window by window, by their words. Repeated chains are then compacted: where a chain has one successor
and that has one predecessor, they join to one path. The words at the source coordinates of a path's occurrences are then
read again, and only occurrences with the words of another one are removed, so colliding hashes take no text away.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, discard, hashed_words, materialize, mix, ragged, text_bytes, text_chunks, window_hashes, word_spans

#: Words of a window, words of the grams of which the least is a window's minimizer.
K, M = 35, 12

_STEP = np.uint64(0xA24BAED4963EE407)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def chains(hashes: np.ndarray, offsets: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, ...]:
    """Super-k-mers of all texts: text, first window (a word's number within the text), windows, minimizer, content."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = window_hashes(hashes, m)
    span = k - m + 1
    n = len(hashes) - k + 1
    if n <= 0:
        return none
    # Place of the least gram (the leftmost of equals) among `span` from each position on, by doubling.
    place, reach = np.arange(len(grams)), 1
    while 2 * reach <= span:
        left, right = place[:-reach], place[reach:]
        place, reach = np.where(grams[right] < grams[left], right, left), 2 * reach
    if reach < span:
        left, right = place[: n], place[span - reach : span - reach + n]
        place = np.where(grams[right] < grams[left], right, left)
    place = place[:n]
    count = np.maximum(np.diff(offsets) - k + 1, 0)
    starts = ragged(offsets[:-1], count)  # windows that don't leave their text
    if len(starts) == 0:
        return none
    owner, spot = np.repeat(np.arange(len(count)), count), place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(starts)))
    begin, spot, owner = starts[first], spot[first], owner[first]
    with np.errstate(over="ignore"):
        up, down = np.full(len(hashes) + 1, _STEP), np.full(len(hashes) + 1, _BACK)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        run = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes) * up[:-1], out=run[1:])
        content = mix((run[begin + size + k - 1] - run[begin]) * down[begin] + ((spot - begin) * 64 + size).astype(np.uint64) * BASE)
    return owner, begin - offsets[owner], size, grams[spot], content


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_a, _b, _t): two numbers that tell a row's id and text, and the text. Rows of equal id and text are alike in all that follows."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_a"), F.xxhash64(t, F.col(id_col).isNull()).alias("_b"), t.alias("_t"))


_CHAINS = "anchor bigint, content bigint, n int, _a bigint, _b bigint, start bigint"


def _chain_rows(k: int, m: int):
    def rows(batches):
        for chunk in text_chunks(batches, "_t"):
            owner, start, size, anchor, content = chains(*hashed_words(chunk.column("_t")), k, m)
            a, b = (chunk.column(c).to_numpy()[owner] for c in ("_a", "_b"))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(a), pa.array(b), pa.array(start)], names=["anchor", "content", "n", "_a", "_b", "start"])

    return rows


def _spaced(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of all texts, each followed by one space; where each word starts there (and the end); the number of words before each text."""
    raw, ends = text_bytes(texts)
    starts, stops, offsets = word_spans(raw, ends)
    lens = stops - starts + 1
    at = ragged(starts, lens)
    data = raw[np.minimum(at, max(0, len(raw) - 1))]
    cuts = np.concatenate([[0], np.cumsum(lens)])
    data[cuts[1:] - 1] = 32
    return data.tobytes(), cuts, offsets


def _digest_rows(k: int, single: bool):
    """For each text and the spans listed beside it (first window, windows, node): a digest of the words that a span covers, or of each of its windows."""

    def rows(batches):
        for chunk in text_chunks(batches, "_t"):
            blob, cuts, offsets = _spaced(chunk.column("_t"))
            lists = chunk.column("parts")
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            start, n, node, lone = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "node", "lone"))
            if single:
                which, at = np.repeat(np.arange(len(start)), n), ragged(start, n.astype(np.int64))
                n = np.ones(len(at), np.int64)
            else:
                which, at = np.arange(len(start)), start
            first = at + offsets[owner[which]]
            digests = [sha256(blob[x:y]).digest()[:16] for x, y in zip(cuts[first].tolist(), cuts[first + n + (k - 1)].tolist())]
            a, b = (chunk.column(c).to_numpy()[owner[which]] for c in ("_a", "_b"))
            yield pa.RecordBatch.from_arrays([pa.array(node[which]), pa.array(digests, pa.binary()), pa.array(lone[which]), pa.array(a), pa.array(b), pa.array(at), pa.array(n.astype(np.int64))], names=["node", "words", "lone", "_a", "_b", "start", "n"])

    return rows


def _digests(keyed: DataFrame, spans: DataFrame, k: int, name: str, single: bool = False) -> DataFrame:
    """`_digest_rows` of spans (_a, _b, start, n, node, lone), read from the texts at their coordinates; written. A repeated row's spans come once for each row."""
    parts = materialize(spans.groupBy("_a", "_b").agg(F.collect_list(F.struct("start", F.col("n").cast("long").alias("n"), "node", "lone")).alias("parts")), "parts")  # no more than one document has
    # The spans grow with the corpus, so they are not broadcast.
    out = keyed.join(parts.hint("merge"), ["_a", "_b"]).select("_a", "_b", "_t", "parts").mapInArrow(_digest_rows(k, single), "node bigint, words binary, lone boolean, _a bigint, _b bigint, start bigint, n bigint")
    out = materialize(out, name)
    discard(parts)
    return out


def repeated_spans(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of words that repeated windows cover: rows (_a, _b, start, stop), one a path and occurrence; spans may overlap. Written."""
    keyed = _keyed(docs, id_col, text_col)
    every = materialize(keyed.mapInArrow(_chain_rows(k, m), _CHAINS), "chains")
    # Minimizers that occur twice: counts are combined before the exchange, however common one is. Here and below aggregates
    # are written before they are joined, so that both sides are exchanges which adaptive execution can split.
    twice = materialize(every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "twice")
    found = materialize(every.join(twice, "anchor"), "repeated")
    discard(every, twice)
    classes = materialize(
        found.groupBy("anchor", "content", "n").agg(F.count("*").alias("c"), F.min(F.struct("_a", "_b", "start")).alias("one")), "classes"
    )
    # Chains of one minimizer that differ, one of them met once only: one occurrence of each is compared window by window,
    # by the windows' words.
    kinds = materialize(classes.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where("kinds > 1 AND least = 1").select("anchor"), "kinds")
    mixed = classes.join(kinds, "anchor").select("one._a", "one._b", "one.start", "n", F.col("anchor").alias("node"), (F.col("c") == 1).alias("lone"))
    windows = _digests(keyed, mixed, k, "windows", single=True)
    same = materialize(windows.groupBy("node", "words").agg(F.countDistinct("_a", "_b", "start").alias("c")).where("c > 1").select("node", "words"), "same")
    single = windows.where("lone").join(same, ["node", "words"]).select(F.col("node").alias("anchor"), F.xxhash64("words").alias("content"), F.lit(1).alias("n"), "_a", "_b", "start", F.lit(True).alias("lone"))
    again = materialize(classes.where("c > 1").select("anchor", "content", "n"), "again")
    whole = found.join(again, ["anchor", "content", "n"]).select("anchor", "content", "n", "_a", "_b", "start", F.lit(False).alias("lone"))
    edges = materialize(whole.unionByName(single).distinct(), "edges")  # rows of equal id and text count once from here on
    discard(found, classes, kinds, windows, same, again)
    spans = compact(edges, keyed, k)
    discard(edges)
    return spans


def compact(edges: DataFrame, keyed: DataFrame, k: int = K) -> DataFrame:
    """Joins repeated chains that follow each other without a branch to paths, and checks these; returns (_a, _b, start, stop). Written.

    A link is kept where a chain is always followed by the same chain (or never by another) and that one never follows
    anything else; the end of a run counts as a successor of its own, so every occurrence of a path's first chain is the
    whole path. The words at a path's source coordinates are read, and an occurrence is returned if they are those of
    another one; `lone` edges are windows whose words have been compared already. Where occurrences of a path disagree
    (its hashes collided), its chains are checked one by one.
    """
    document = Window.partitionBy("_a", "_b").orderBy("start")
    node = F.xxhash64("anchor", "content", "n")
    e = edges.select("_a", "_b", "start", "n", "lone", node.alias("v"))
    e = e.withColumn("at", F.lead("start").over(document)).withColumn("to", F.lead("v").over(document))
    linked = F.col("at") == F.col("start") + F.col("n")
    e = materialize(e.select("_a", "_b", "start", "n", "lone", "v", F.when(linked, F.col("to")).alias("to")), "arcs")
    arcs = materialize(e.groupBy("v", "to").agg(F.count("*").alias("c")), "followed")  # combined before the exchange
    begins = arcs.groupBy("v").agg(F.sum("c").alias("all")).join(arcs.where("to IS NOT NULL").groupBy(F.col("to").alias("v")).agg(F.sum("c").alias("entered")), "v", "left")
    one_out = arcs.groupBy("v").agg(F.count("*").alias("out")).where("out = 1").select("v")
    ins = arcs.where("to IS NOT NULL").groupBy("to").agg(F.count("*").alias("in"))
    one_in = ins.where("in = 1").join(begins.where("all = entered").select(F.col("v").alias("to")), "to").select("to")
    links = materialize(arcs.where("to IS NOT NULL").join(one_out, "v", "left_semi").join(one_in, "to", "left_semi").select("v", "to", F.lit(1).alias("go")), "links")
    marked = e.join(links, ["v", "to"], "left")
    before = F.lag("go").over(document)
    joined = F.coalesce(before, F.lit(0)) * (F.lag(F.col("start") + F.col("n")).over(document) == F.col("start")).cast("int")
    runs = marked.withColumn("head", F.coalesce(1 - joined, F.lit(1))).withColumn("path", F.sum("head").over(document.rowsBetween(Window.unboundedPreceding, 0)))
    paths = runs.groupBy("_a", "_b", "path").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - F.min("start")).alias("n"), F.min_by("v", "start").alias("node"), F.min("lone").alias("lone"))
    paths = materialize(paths.drop("path"), "paths")

    def agreed(spans: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        told = _digests(keyed, spans, k, f"{name}-words")
        seen = materialize(told.groupBy("node", "words").agg(F.count("*").alias("c")).where("c > 1").select("node", "words", F.lit(True).alias("good")), f"{name}-seen")
        checked = materialize(told.join(seen, ["node", "words"], "left").select("_a", "_b", "start", "n", F.coalesce("good", F.lit(False)).alias("good")), name)
        discard(told, seen)
        return checked.where("good").drop("good"), checked

    sound, checked = agreed(paths.where("NOT lone"), "checked")
    spans = paths.where("lone").select("_a", "_b", "start", "n").union(sound)
    wrong = materialize(checked.where("NOT good").select("_a", "_b", "start", "n").distinct(), "wrong")
    if not wrong.isEmpty():
        inside = (F.col("e._a") == F.col("w._a")) & (F.col("e._b") == F.col("w._b")) & (F.col("e.start") >= F.col("w.start")) & (F.col("e.start") < F.col("w.start") + F.col("w.n"))
        pieces = e.alias("e").join(wrong.alias("w"), inside, "left_semi")
        doubtful = materialize(pieces.where("NOT lone").select("v").distinct(), "doubtful")
        good, _ = agreed(e.join(doubtful, "v", "left_semi").select("_a", "_b", "start", "n", F.col("v").alias("node"), "lone"), "again")
        spans = spans.union(pieces.where("lone").select("_a", "_b", "start", "n")).union(good)
    spans = materialize(spans.select("_a", "_b", "start", (F.col("start") + F.col("n") + (k - 1)).alias("stop")), "spans")
    discard(e, arcs, links, paths, checked, wrong)
    return spans


def _kept(spaced: bool):
    """What is left of each text, its words joined by one space; texts that lose nothing keep their own white space if not `spaced`."""

    def rows(batches):
        for chunk in text_chunks(batches, "_t"):
            raw, ends = text_bytes(chunk.column("_t"))
            starts, stops, offsets = word_spans(raw, ends)
            n = np.diff(offsets)
            lists = chunk.column("spans")
            full = lists.is_valid().to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy()) * full
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), size)
            lo, hi = (flat.field(c).to_numpy(zero_copy_only=False) + offsets[owner] for c in ("start", "stop"))
            depth = np.zeros(len(starts) + 1, np.int64)
            np.add.at(depth, lo, 1)
            np.add.at(depth, hi, -1)
            keep = np.cumsum(depth)[:-1] == 0
            left = np.concatenate([[0], np.cumsum(keep)])[offsets]
            starts, lens = starts[keep], (stops - starts)[keep] + 1
            at = ragged(starts, lens)
            data = raw[np.minimum(at, len(raw) - 1)] if len(at) else raw[:0]
            cuts = np.cumsum(lens)
            data = data.copy()
            data[cuts - 1] = 32
            edge = np.concatenate([[0], cuts])[left]
            blob = data.tobytes()
            texts = [blob[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            removed = n - np.diff(left)
            if not spaced:
                texts = [t if r else x for t, r, x in zip(texts, removed.tolist(), chunk.column("_t").cast(pa.large_binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([chunk.column("_row"), pa.array(n), pa.array(removed), pa.array(texts, pa.binary()).cast(pa.string())], names=["_row", "n_words", "n_removed", "kept"])

    return rows


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text", spaced: bool = True) -> DataFrame:
    """Every row with its own columns as a struct `_row`, n_words, n_removed and `kept`, the text without the words of windows that occur twice.

    Windows are judged on the input. Null and empty texts have no words; texts of fewer than k words lose none; very long
    texts are read whole, one of them in memory at a time; a repeated row's windows occur twice, so both lose theirs; rows
    with null ids count like others; an empty table gives an empty one; other columns are in `_row` if not `spaced`, else
    ignored, whatever their names.
    """
    spans = repeated_spans(docs, k, m, id_col, text_col)
    lists = materialize(spans.groupBy("_a", "_b").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "lists")
    discard(spans)
    t = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if spaced is False or c == id_col])
    keyed = docs.select(row.alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_a"), F.xxhash64(t, F.col(id_col).isNull()).alias("_b"), t.alias("_t"))
    kind = keyed.schema["_row"].dataType.simpleString()
    both = keyed.join(lists.hint("merge"), ["_a", "_b"], "left").select("_row", "_t", "spans")
    return both.mapInArrow(_kept(spaced), f"_row {kind}, n_words bigint, n_removed bigint, kept string")


def digest(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs, k, m).select("_row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """The rows of `docs` with its columns (doc_id, text, n_chars among them): texts that lose words hold what is left, joined by one space."""
    kept = remove_repeats(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col("doc_id"), F.col("text")).select("_all", "doc_id", "text"), k, m, spaced=False)
    out = []
    for c in docs.columns:
        old = F.col("_row._all").getField(c)
        value = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(old), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(old)}.get(c, old)
        out.append(value.alias(c))
    return kept.select(*out)
