"""Problem 3: long exact spans shared between records.

1. Anchors. Of every piece of `least` characters the least hash among its grams of `least // 2`
   characters names the anchor: a choice by content alone, so equal pieces have equal anchors. One row per
   anchor and text, with the range of pieces that it stands for.
2. Recurring passages: anchors of at least two texts, confirmed by their characters, not their hash.
3. The confirmed passages are sharded, each shard's are compiled into one Aho-Corasick automaton, and the
   surroundings of every occurrence stream through the automaton of their shard. A shard's passages
   are bounded; its texts are salted over several tasks and never held together.
4. Surroundings that are equal as a whole are settled by one aggregate. Only where a passage has several
   surroundings, at the ends of shared spans, the single pieces are compared, again by an aggregate, so
   a passage in a third of all records costs no pairs. Pieces found are merged for each record.

Defined results
- null text or key, and texts of fewer than `least` characters: no row. Ends are exclusive, code points.
- rows of one key never share with each other; a key with several texts reports each text's spans.
- a text under two keys is shared as a whole.
- columns besides the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.wordsets import keyed, mix
from quillmesh.tables import written

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Up to so many 8-byte anchors are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def gram_hashes(codes: np.ndarray, size: int, tables: dict[str, np.ndarray]) -> np.ndarray:
    """A hash of each gram of `size` characters; `tables` keeps the powers from call to call."""
    n = len(codes)
    with np.errstate(over="ignore"):
        if len(tables.get("up", ())) <= n:
            tables["up"] = np.cumprod(np.r_[np.uint64(1), np.full(n + n // 4, _BASE, np.uint64)])
            tables["down"] = np.cumprod(np.r_[np.uint64(1), np.full(n + n // 4, _INVERSE, np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum(mix(codes + np.uint64(_BASE)) * tables["up"][:n])]
        return mix((sums[size:] - sums[:-size]) * tables["down"][: n - size + 1])


def least_in_windows(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each window of `span` values, by running minima of blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // span) * span, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - span + 1], ahead[span - 1 : n])


def anchors(texts: list[str], least: int, tables: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(hash, text, place, first piece, last piece) of each anchor of some texts of at least `least` characters.

    Piece p of a text is text[p : p + least]. The texts are hashed as one row of characters; grams and
    pieces that would reach over an end are never looked at.
    """
    gram = least // 2
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts])
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    hashes = gram_hashes(codes, gram, tables)
    # The upper 32 bits choose, the lower ones hold the place: of equal hashes the first one.
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    pieces = sizes - least + 1
    text = np.repeat(np.arange(len(texts)), pieces)
    piece = np.arange(len(text)) - np.repeat(np.r_[0, np.cumsum(pieces)[:-1]], pieces)
    place = (least_in_windows(ranked, least - gram + 1)[piece + begins[text]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[first[1:] - 1, len(place) - 1]
    of = text[first]
    return hashes[place[first]].view(np.int64), of, place[first] - begins[of], piece[first], piece[last]


def in_lots(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together."""
    begin, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= most:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Stretches that overlap or touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def shared_spans(df: DataFrame, key: str, text: str, least: int = 100, per_shard: int = 5_000, per_task: int = 200_000) -> DataFrame:
    """(rec_key, start_pos, end_pos, n_chars): stretches covered by pieces of `least` characters of another key's text.

    n_chars is the length of the record's text, so that a record's share is a sum over its rows.
    """
    gram = least // 2
    rows = keyed(df, key, text).select("key", "tid", "text")
    # first and last stand for the least and the greatest key: they differ if there are several.
    texts = rows.where(F.length("text") >= least).withColumn("k", F.xxhash64("key")).groupBy("tid").agg(F.first("text").alias("text"), F.min("k").alias("first"), F.max("k").alias("last"))
    texts = written(texts.withColumn("sid", F.monotonically_increasing_id()), "texts")

    def found_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, sids = batch["text"].tolist(), batch["sid"].to_numpy(np.int64)
            for a, b in in_lots(texts):
                anchor, of, place, lo, hi = anchors(texts[a:b], least, tables)
                yield pd.DataFrame({"anchor": anchor, "sid": sids[a:b][of], "place": place.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

    # Made twice, which is cheaper than to keep.
    every = texts.select("sid", "text").mapInPandas(found_anchors, "anchor bigint, sid bigint, place int, lo int, hi int")
    recurring = written(every.groupBy("anchor").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b").select("anchor"), "recurring")
    some = F.broadcast(recurring) if recurring.count() <= BROADCAST_ROWS else recurring
    at = every.join(some, "anchor").groupBy("sid").agg(F.collect_list(F.struct("anchor", "place", "lo", "hi")).alias("at"))  # of one text: as many as it has anchors
    cut = at.join(texts.select("sid", "first", "last", "text"), "sid").select("sid", "first", "last", "text", F.explode("at").alias("at"))
    # substring counts code points, from 1
    units = cut.select(
        "sid", "first", "last", F.col("at.anchor").alias("anchor"), F.col("at.lo").alias("lo"), (F.col("at.place") - F.col("at.lo")).alias("off"),
        F.expr("substring(text, at.lo + 1, at.hi - at.lo + %d)" % least).alias("around"),
    )
    units = written(units, "units")
    phrase = F.expr(f"substring(around, off + 1, {gram})")
    confirmed = units.select("anchor", "sid", phrase.alias("phrase")).groupBy("anchor", "phrase").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b").select("anchor", "phrase")
    confirmed = written(confirmed, "passages")
    # Shards hold about `per_shard` passages; one with many surroundings is salted over several tasks, its book copied to each.
    shards = max(1, -(-confirmed.count() // per_shard))
    shard = F.pmod("anchor", F.lit(shards)).cast("int").alias("shard")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("sid", "bigint"), ("first", "bigint"), ("last", "bigint"), ("lo", "int"), ("off", "int"))]
    stream = units.select(shard, F.lit(1).alias("kind"), "anchor", "around", "sid", "first", "last", "lo", "off")
    salts = units.select(shard).groupBy("shard").agg(F.ceil(F.count("*") / per_task).cast("int").alias("salts"))
    stream = stream.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int")).drop("salts")
    book = confirmed.select(shard, F.lit(0).alias("kind"), "anchor", F.col("phrase").alias("around"), *nothing)
    book = book.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    tasks = book.unionByName(stream).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick
        import xxhash

        here, made, ready = None, ahocorasick.Automaton(), False
        for batch in batches:
            keep, region = [], []
            for k, (shard, salt, kind, around, off) in enumerate(zip(batch["shard"], batch["salt"], batch["kind"], batch["around"], batch["off"])):
                if here != (shard, salt):
                    here, made, ready = (shard, salt), ahocorasick.Automaton(), False
                if kind == 0:
                    made.add_word(around, True)
                    continue
                if not ready:
                    made.make_automaton()
                    ready = True
                if len(made) and any(end - gram + 1 == off for end, _ in made.iter(around)):
                    keep.append(k)
                    region.append(xxhash.xxh3_64_intdigest(around.encode("utf-8", "surrogatepass")))
            found = batch.iloc[keep]
            yield pd.DataFrame({"region": np.array(region, np.uint64).view(np.int64), "size": found["around"].str.len().astype(np.int32)} | {c: found[c].to_numpy(t) for c, t in (("sid", np.int64), ("first", np.int64), ("last", np.int64), ("anchor", np.int64), ("lo", np.int32), ("off", np.int32))})

    located_ = written(tasks.mapInPandas(located, "region bigint, size int, sid bigint, first bigint, last bigint, anchor bigint, lo int, off int"), "located")
    # Equal surroundings of one passage: one region each, with the least and greatest key that holds it.
    regions = located_.groupBy("anchor", "off", "region").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min(F.struct("sid", "lo")).alias("at"))
    regions = written(regions.withColumn("rid", F.monotonically_increasing_id()), "regions")
    open_ = regions.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if(F.col("first") == F.col("last")).alias("alone")).where("n > 1 and alone > 0").select("anchor")
    shown = written(regions.join(open_, "anchor").select("off", "rid", "first", "last", "at.sid", "at.lo", "anchor"), "shown")
    shown = units.select("sid", "lo", "around").join(F.broadcast(shown) if shown.count() <= BROADCAST_ROWS // 5 else shown, ["sid", "lo"])
    pieces = shown.select("anchor", "off", "rid", "first", "last", "around", F.explode(F.sequence(F.lit(0), F.length("around") - least)).alias("k"))
    # A piece is told by its anchor, the anchor's place in it, and its characters.
    pieces = pieces.select(F.xxhash64("anchor", F.col("off") - F.col("k"), F.expr(f"substring(around, k + 1, {least})")).alias("piece"), "rid", "k", "first", "last")
    pieces = written(pieces, "pieces")
    shared = pieces.groupBy("piece").agg(F.min("first").alias("a"), F.max("last").alias("b")).where("a <> b").select("piece")
    partly = pieces.where(F.col("first") == F.col("last")).select("piece", "rid", "k").join(shared, "piece")
    partly = partly.groupBy("rid").agg(F.array_sort(F.collect_list("k")).alias("ks"))  # of one region: at most as many as pieces have places
    partly = regions.select("anchor", "off", "region", "rid").join(partly, "rid").drop("rid")
    whole = regions.where("first <> last").select("anchor", "off", "region", F.lit(None).cast("array<int>").alias("ks"))
    hits = located_.select("sid", "anchor", "off", "lo", "region", "size").join(partly.unionByName(whole), ["anchor", "off", "region"])
    of_text = hits.groupBy("sid").agg(F.collect_list(F.struct("lo", "size", "ks")).alias("all"))  # of one text: as many as it has anchors
    copies = texts.where("first <> last").select("sid", F.array(F.struct(F.lit(0).alias("lo"), F.length("text").alias("size"), F.lit(None).cast("array<int>").alias("ks"))).alias("all"))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sid, every in zip(batch["sid"], batch["all"]):
                starts, ends = [], []
                for x in every:
                    if x["ks"] is None:
                        starts.append(x["lo"])
                        ends.append(x["lo"] + x["size"])
                    else:
                        starts += [x["lo"] + k for k in x["ks"]]
                        ends += [x["lo"] + k + least for k in x["ks"]]
                out.append((sid, [{"start_pos": a, "end_pos": b} for a, b in merged(starts, ends)]))
            yield pd.DataFrame(out, columns=["sid", "spans"])

    both = of_text.join(copies.select("sid"), "sid", "left_anti").unionByName(copies)
    spans = both.mapInPandas(one, "sid bigint, spans array<struct<start_pos:int,end_pos:int>>").join(texts.select("sid", "tid"), "sid").select("tid", "spans")
    return rows.select(F.col("key").alias("rec_key"), "tid", F.length("text").alias("n_chars")).distinct().join(spans, "tid").select("rec_key", "n_chars", F.inline("spans")).distinct()


def shared_shares(df: DataFrame, key: str, text: str, least: int = 100) -> DataFrame:
    """(rec_key, n_chars, shared_chars, share) for each record with a shared stretch."""
    return shared_spans(df, key, text, least).groupBy("rec_key", "n_chars").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars")).withColumn("share", F.col("shared_chars") / F.col("n_chars"))
