"""The documents that share most tokens with each query, counted block by block.

Queries of one organisation go to groups, documents of one to blocks with inverted lists; a group meets every block
that its organisation may see in one task, which keeps each query's best so far. So no pair of query and document is ever
shuffled or written: only the queries once, and each block once for each group that sees it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import prints, text
from quillmesh.tables import written

#: How many queries a group holds, and how many documents a block, about.
GROUP, BLOCK = 16_384, 4096
#: A query's order of documents as one number: shared tokens, the first one's position from behind, the document's place among the ids from behind.
POSITION, PLACE = 1 << 17, 1 << 28


def _sealed(**columns: pa.Array) -> bytes:
    """Arrays of different lengths as one compressed value."""
    one = pa.table({k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(one)
    return sink.getvalue().to_pybytes()


def _opened(data: bytes) -> dict[str, pa.Array]:
    one = pa.ipc.open_stream(data).read_all()
    return {k: one[k].combine_chunks().flatten() for k in one.column_names}


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _block(docs: pa.Table) -> pa.Table:
    """Documents in order of their ids: with the list of documents of each term, and, if there are sentences, these in a second row."""
    docs = docs.sort_by("doc_id")
    terms = docs["terms"].combine_chunks()
    coded = terms.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    columns = {"ids": docs["doc_id"].combine_chunks(), "terms": coded.dictionary, "n": pa.array(np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32)), "docs": pa.array(np.repeat(np.arange(len(docs), dtype=np.int32), _lengths(terms))[order])}
    sealed = []
    if "said" in docs.column_names:
        said = docs["said"].combine_chunks()
        tokens, normal = said.flatten().field("tokens"), said.flatten().field("normal")
        token = pc.index_in(tokens.flatten(), value_set=coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        once = np.unique(np.repeat(np.arange(len(tokens)), _lengths(tokens)) * len(coded.dictionary) + token) % max(1, len(coded.dictionary))
        columns |= {"df": pa.array(np.bincount(once, minlength=len(coded.dictionary))), "sentences": pa.array([len(tokens)])}
        of, prints = fingerprints(tokens)
        sealed = [_sealed(many=pa.array(_lengths(said)), terms=coded.dictionary, tokens=pa.array(token.astype(np.int32)), lengths=pa.array(_lengths(tokens).astype(np.int32)), normal=normal, of=pa.array(of.astype(np.int32)), prints=pa.array(prints.astype(np.uint32)))]
    sealed = [_sealed(**columns), *sealed]
    return pa.table({"doc_org": docs["doc_org"].take([0] * len(sealed)), "block": docs["block"].take([0] * len(sealed)), "part": pa.array(range(1, len(sealed) + 1), pa.int32()), "data": pa.array(sealed, pa.binary())})


def _blocks(corpus: DataFrame, sentences: bool) -> DataFrame:
    """(doc_org, block, part, data): the corpus (doc_id, org_id, sent_idx, sentence) as blocks of documents of one organisation; part 2: their sentences."""
    docs = corpus.where("org_id is not null").select("doc_id", F.col("org_id").alias("doc_org"), "sent_idx", text.tokens(F.col("sentence")).alias("tokens"), *[prints.shingle_text(F.col("sentence")).alias("normal")] * sentences)
    said = F.array_sort(F.collect_list(F.struct("sent_idx", "tokens", "normal"))).alias("said")  # a document's sentences
    docs = written(docs.groupBy("doc_id", "doc_org").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("terms"), *[said] * sentences), "terms")
    cut = docs.groupBy("doc_org").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = docs.join(cut, "doc_org").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).drop("blocks")
    return written(placed.groupBy("doc_org", "block").applyInArrow(_block, "doc_org string, block int, part int, data binary"), "blocks")


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])


def fingerprints(tokens: pa.ListArray, k: int = 5, w: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct fingerprints of each row, as prints.fingerprint makes them."""
    n = _lengths(tokens)
    ended = pc.binary_join_element_wise(tokens.flatten().cast("large_string"), pa.scalar("", "large_string"), pa.scalar("\0", "large_string"))
    at = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1] if len(ended) else np.zeros(1, np.int64)
    signs = np.frombuffer(ended.buffers()[2], np.uint8) if len(ended) else np.zeros(0, np.uint8)
    row, inside = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.flatnonzero(inside + k <= np.repeat(n, n))
    row, begins, length = row[first], at[first], at[first + k] - 1 - at[first]
    hashes, active, j = np.full(len(first), 2166136261, np.uint64), np.arange(len(first)), 0
    while len(active := active[length[active] > j]):
        hashes[active] = ((hashes[active] ^ signs[begins[active] + j]) * np.uint64(16777619)) & np.uint64(4294967295)
        j += 1
    grams = np.maximum(n - k + 1, 0)[row]
    place = inside[first]
    whole = np.flatnonzero(place + w <= grams)
    least = np.minimum.reduce([hashes[whole + i] for i in range(w)]) if len(whole) else hashes[:0]
    few = grams < w
    both = np.unique(np.r_[row[whole], row[few]].astype(np.uint64) << np.uint64(32) | np.r_[least, hashes[few]])
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(4294967295)).astype(np.int64)


#: Letters, digits, the line and the space, of which a normalised text consists.
SIGNS = np.full(256, 38, np.int64)
SIGNS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_ ", np.uint8)] = np.arange(38)


def shingles(normal: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of each run of k characters of normalised texts, repeats included; a code is the run itself as a number."""
    normal = normal.cast("large_string")
    n = pc.binary_length(normal).to_numpy(zero_copy_only=False).astype(np.int64)
    if n.sum() < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.frombuffer(normal.buffers()[1], np.int64)[normal.offset]
    signs = SIGNS[np.frombuffer(normal.buffers()[2], np.uint8)[at : at + n.sum()]]
    first = np.flatnonzero(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + k <= np.repeat(n, n))
    code = np.zeros(len(first), np.int64)
    for i in range(k):
        code = code * 38 + signs[first + i]
    return np.repeat(np.arange(len(n)), n)[first], code


class Postings:
    """The rows of each value."""

    def __init__(self, rows: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(values, kind="stable")
        rows, values = rows[order], values[order]
        new = np.r_[True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])][: len(rows)]
        self.rows, values = rows[new], values[new]
        self.begins = _runs(values)
        self.values, self.n = values[self.begins], np.diff(np.r_[self.begins, len(values)])

    def of(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows of each value begin, and how many."""
        if not len(self.values):
            return np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        return self.begins[at], np.where(self.values[at] == values, self.n[at], 0)


class Sets:
    """A set of values for each query."""

    def __init__(self, rows: np.ndarray, values: np.ndarray, n: int) -> None:
        order = np.lexsort((values, rows))
        rows, values = rows[order], values[order]
        new = np.r_[True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])][: len(rows)]
        self.values, self.rows = values[new], rows[new]
        self.size = np.bincount(self.rows, minlength=n)
        self.ends = np.cumsum(self.size)

    def meet(self, postings: Postings) -> None:
        self.postings, (self.at, self.n) = postings, postings.of(self.values)

    def met(self, q: int) -> tuple[np.ndarray, slice, np.ndarray]:
        """The rows that hold a value of the query, as often as they do, and the values' numbers of rows."""
        of = slice(int(self.ends[q] - self.size[q]), int(self.ends[q]))
        n = self.n[of]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[of] - (ends - n), n)
        return self.postings.rows[at], of, n

    def shared(self, q: int, rows: int, of: np.ndarray) -> np.ndarray:
        return np.bincount(self.met(q)[0], minlength=rows)[of]


class Asking:
    """The queries of a group and the best documents that they have met."""

    def __init__(self, rows: pa.Table, most: int) -> None:
        self.rows, self.most, self.ids = rows, most, []
        tokens = rows["tokens"].combine_chunks()
        self.begins = np.r_[0, np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))].astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        self.terms, self.codes = coded.dictionary, coded.indices.to_numpy()
        self.score, self.at = np.zeros((len(rows), most), np.int64), np.zeros((len(rows), most), np.int32)

    def meet(self, data: bytes) -> None:
        held = _opened(data)
        n, base = len(held["ids"]), sum(map(len, self.ids))
        self.ids.append(held["ids"])
        here = pc.fill_null(pc.index_in(self.terms, value_set=held["terms"]), -1).to_numpy(zero_copy_only=False)
        row = np.full(len(held["terms"]) + 1, -1, np.int64)  # the last is for terms that no document here has
        used = here[here >= 0]
        row[used] = np.arange(len(used))
        term = row[np.repeat(np.arange(len(held["terms"])), held["n"].to_numpy())]
        has = np.zeros((len(used), n), np.uint8)
        has[term[term >= 0], held["docs"].to_numpy()[term >= 0]] = 1
        rows, best, place = row[here][self.codes], min(n, self.most), self._places()
        for s in range(0, len(self.rows), 1024):
            e = min(len(self.rows), s + 1024)
            score, at = np.zeros((e - s, best), np.int64), np.zeros((e - s, best), np.int32)
            least = self.score[s:e].min(1)
            for q in range(s, e):
                of = rows[self.begins[q] : self.begins[q + 1]]
                known = np.flatnonzero(of >= 0)
                if not len(known):
                    continue
                m = len(of)
                kind = np.uint8 if m < 256 else np.int32
                found = has[of[known]].astype(kind, copy=False)
                shared = np.add.reduce(found, axis=0, dtype=kind)
                first = np.maximum.reduce(found * (m - known).astype(kind)[:, None], axis=0)  # the earlier, the larger
                order = shared.astype(np.uint16) * np.uint16(256) + first if m < 256 else shared.astype(np.int64) * POSITION + first
                cut, was = 1, int(least[q - s])
                if was:  # what is worse than all that it keeps is left out
                    cut = was // POSITION * (256 if m < 256 else POSITION) + m - (POSITION - 1 - was % POSITION)
                some = np.flatnonzero(order >= cut)
                if len(some) > best:
                    order = order[some]
                    cut = int(np.partition(order, len(order) - best)[len(order) - best])
                    above = some[order > cut]
                    some = np.concatenate([above, some[order == cut][: best - len(above)]])  # of smaller ids
                at[q - s, : len(some)] = some + base
                score[q - s, : len(some)] = shared[some].astype(np.int64) * POSITION + (POSITION - 1 - m) + first[some]
            self._keep(s, e, score, at, place)

    def _places(self) -> np.ndarray:
        """The place of each document met so far in the order of the ids."""
        order = pc.sort_indices(pa.chunked_array(self.ids)).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place

    def _order(self, score: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Columns of each row, the best first."""
        if score.max(initial=0) < POSITION * POSITION and len(place) < PLACE:
            return np.argsort(-(score * PLACE - place[at]), axis=1)
        return np.lexsort((place[at], -score), axis=1)

    def _keep(self, s: int, e: int, score: np.ndarray, at: np.ndarray, place: np.ndarray) -> None:
        if len(self.ids) > 1:
            score, at = np.concatenate([self.score[s:e], score], 1), np.concatenate([self.at[s:e], at], 1)
            order = self._order(score, at, place)[:, : self.most]
            score, at = np.take_along_axis(score, order, 1), np.take_along_axis(at, order, 1)
        self.score[s:e, : score.shape[1]], self.at[s:e, : at.shape[1]] = score, at

    def settled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best documents of each query in order, what they share, and how many they are; those that share nothing with any get the first ids."""
        place = self._places()
        first = np.argsort(place)[: self.most].astype(np.int32)
        for s in range(0, len(self.rows), 1024):
            of = slice(s, s + 1024)
            order = self._order(self.score[of], self.at[of], place)
            self.score[of], self.at[of] = np.take_along_axis(self.score[of], order, 1), np.take_along_axis(self.at[of], order, 1)
        none = np.flatnonzero(self.score[:, 0] == 0)
        self.at[none[:, None], np.arange(len(first))] = first
        many = (self.score > 0).sum(1)
        many[none] = len(first)
        return self.at, self.score // POSITION, many

    def best(self, columns: list[str]) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        at, shared, many = self.settled()
        ids = pa.chunked_array(self.ids).combine_chunks()
        for s in range(0, len(self.rows), 1024):
            of = slice(s, s + 1024)
            kept = np.arange(self.most) < many[of, None]
            lists = pa.StructArray.from_arrays([ids.take(pa.array(at[of][kept])), pa.array(shared[of][kept])], ["doc_id", "shared"])
            out = pa.table([*(self.rows.slice(s, 1024)[c] for c in columns), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many[of])].astype(np.int32)), lists)], [*columns, "best"])
            yield from out.combine_chunks().to_batches()


class Scoring(Asking):
    """The queries of a group, their candidates, and the scores of their sentences. Queries have all (their tokens with repeats) and normal besides."""

    def __init__(self, rows: pa.Table, most: int, stop: list[str], sources: int | None, threshold: float) -> None:
        super().__init__(rows, most)
        self.stop, self.sources, self.threshold, self.df, self.total, self.pairs, self.done = pa.array(stop), sources, threshold, [], 0, None, 0
        n, every, normal = len(rows), rows["all"].combine_chunks(), rows["normal"].combine_chunks()
        self.every = every
        self.prints = Sets(*fingerprints(every), n)
        self.grams = {k: Sets(*shingles(normal, k), n) for k in (4, 6, 9)}
        self.found: list[tuple] = []

    def meet(self, data: bytes) -> None:
        super().meet(data)
        held = _opened(data)
        self.df.append(pa.table({"term": held["terms"], "df": held["df"]}))
        self.total += held["sentences"][0].as_py()

    def _start(self) -> None:
        """What can be made when all documents are known: the candidates, and the weights of terms."""
        at, _, many = self.settled()
        self.pairs = np.repeat(np.arange(len(at)), many), at[np.arange(self.most) < many[:, None]].astype(np.int64)
        self.names, self.sizes, self.block = pa.chunked_array(self.ids).combine_chunks(), [len(x) for x in self.ids], 0
        df = pa.concat_tables(self.df).group_by("term").aggregate([("df", "sum")])
        flat = self.every.flatten()
        self.terms = pa.concat_arrays([x.cast("string") for x in (df["term"].combine_chunks(), flat)]).unique()
        self.idf = np.full(len(self.terms), np.log(2.0) + 1)
        self.idf[pc.index_in(df["term"].combine_chunks(), value_set=self.terms).to_numpy()] = np.log((self.total + 1) / (df["df_sum"].to_numpy() + 1)) + 1
        self.content = ~pc.is_in(self.terms, value_set=self.stop).to_numpy(zero_copy_only=False)
        codes = pc.index_in(flat, value_set=self.terms).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(self.every)), _lengths(self.every))
        self.words = Sets(rows, codes, len(self.every))
        self.vectors = Sets(*self._weights(rows, codes, len(self.every))[:2], len(self.every))
        _, _, self.weight, self.norm = self._weights(rows, codes, len(self.every))

    def _weights(self, rows: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) in that order of terms that are content, and each row's norm."""
        kept = self.content[codes]
        rows, codes = rows[kept], codes[kept]
        size = np.bincount(rows, minlength=n)
        both, tf = np.unique(rows * len(self.terms) + codes, return_counts=True)
        rows, codes = both // max(1, len(self.terms)), both % max(1, len(self.terms))
        weight = tf / size[rows] * self.idf[codes]
        return rows, codes, weight, np.sqrt(np.bincount(rows, weight * weight, minlength=n))

    def score_block(self, data: bytes) -> Iterator[pa.RecordBatch]:
        if self.pairs is None:
            self._start()
        held, docs, base = _opened(data), self.sizes[self.block], sum(self.sizes[: self.block])
        self.block += 1
        here = np.flatnonzero((self.pairs[1] >= base) & (self.pairs[1] < base + docs))
        if not len(here):
            return
        q, doc = self.pairs[0][here], self.pairs[1][here] - base
        many, lengths = held["many"].to_numpy(), held["lengths"].to_numpy()
        starts, n = np.cumsum(many) - many, len(lengths)
        term = pc.index_in(held["terms"], value_set=self.terms).to_numpy(zero_copy_only=False).astype(np.int64)
        row, code = np.repeat(np.arange(n), lengths), term[held["tokens"].to_numpy()] if len(held["tokens"]) else np.zeros(0, np.int64)
        distinct = np.bincount(np.unique(row * len(self.terms) + code) // max(1, len(self.terms)), minlength=n)
        r, c, weight, norm = self._weights(row, code, n)
        order = np.argsort(c, kind="stable")  # as the postings have them
        weight = weight[order]
        self.vectors.meet(Postings(r, c))
        self.prints.meet(Postings(held["of"].to_numpy().astype(np.int64), held["prints"].to_numpy().astype(np.int64)))
        for k, of in self.grams.items():
            of.meet(Postings(*shingles(held["normal"], k)))
        if self.sources is None:
            self.words.meet(Postings(row, code))
        begins = _runs(q)
        said = _lengths(self.every)
        waiting, held_rows = [], 0
        for s, e in zip(begins, [*begins[1:], len(q)]):
            query, of = int(q[s]), doc[s:e]
            count = many[of]
            ends = np.cumsum(count)
            inside = np.arange(ends[-1]) - np.repeat(ends - count, count)
            sentence = inside + np.repeat(starts[of], count)
            share = lambda sets, query=query, sentence=sentence: sets.shared(query, n, sentence) / sets.size[query] if sets.size[query] else np.zeros(len(sentence))
            w = share(self.prints) if said[query] >= 6 else np.zeros(len(sentence))
            sh = 0.25 * share(self.grams[4]) + 0.45 * share(self.grams[6]) + 0.30 * share(self.grams[9])
            met, terms, times = self.vectors.met(query)
            at = np.arange(len(met)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.vectors.at[terms], times)
            dot = np.bincount(met, np.repeat(self.weight[terms], times) * weight[at], minlength=n)[sentence]
            norms = self.norm[query] * norm[sentence]
            cos = np.divide(dot, norms, out=np.zeros(len(dot)), where=norms > 0)
            w, cos, sh = (np.floor(x * 1e6 + 0.5) / 1e6 for x in (w, cos, sh))
            if self.sources is None:
                both = self.words.shared(query, n, sentence)
                either = self.words.size[query] + distinct[sentence] - both
                jaccard = np.floor(np.divide(both, either, out=np.zeros(len(both)), where=(either > 0) & (distinct[sentence] > 0)) * 1e6 + 0.5) / 1e6
                waiting.append((query, base + np.repeat(of, count), inside, w, cos, sh, jaccard))
                if (held_rows := held_rows + len(inside)) > 100_000:
                    yield self._all(waiting)
                    waiting, held_rows = [], 0
            else:
                score = np.maximum(np.maximum(w, cos), sh)
                first = np.lexsort((inside, -score, np.repeat(np.arange(len(of)), count)))[ends - count]  # the best of each document
                first = first[score[first] > self.threshold]
                method = np.where((w > 0) & (score == w), 0, np.where((cos > 0) & (score == cos), 1, np.where(sh > 0, 2, 3)))
                if len(first):
                    top = first
                    if len(first) > self.sources:  # equal scores are told apart by ids at the end
                        top = first[score[first] >= np.partition(score[first], len(first) - self.sources)[len(first) - self.sources]]
                    to = np.repeat(of, count)[top]
                    self.found.append((np.full(len(top), query), base + to, score[top], method[top]))
        if waiting:
            yield self._all(waiting)

    def _all(self, waiting: list[tuple]) -> pa.RecordBatch:
        doc, idx, w, cos, sh, jaccard = (np.concatenate([x[i] for x in waiting]) for i in range(1, 7))
        lists = pa.StructArray.from_arrays([self.names.take(pa.array(doc)), pa.array(idx.astype(np.int32)), *map(pa.array, (w, cos, sh, jaccard))], ["doc_id", "sent_idx", "w", "cos", "sh", "jaccard"])
        ends = np.cumsum([len(x[2]) for x in waiting])
        return self._named([x[0] for x in waiting], ends, lists)

    def _named(self, queries: list, ends: np.ndarray, lists: pa.Array) -> pa.RecordBatch:
        of = self.rows.take(pa.array(queries, pa.int64()))
        return pa.table([of["qid"], of["org_id"], of["text"], pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), lists)], ["qid", "org_id", "text", "best"]).combine_chunks().to_batches()[0]

    def best(self, columns: list[str]) -> Iterator[pa.RecordBatch]:
        if not self.found:
            return
        q, doc, score, method = (np.concatenate([x[i] for x in self.found]) for i in range(4))
        order = np.lexsort((self._places()[doc], -score, q))
        q, doc, score, method = q[order], doc[order], score[order], method[order]
        begins = _runs(q)
        rank = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)]))
        some = np.flatnonzero(rank < self.sources)
        q, doc, score, method = q[some], doc[some], score[some], method[some]
        begins = _runs(q)
        lists = pa.StructArray.from_arrays([self.names.take(pa.array(doc)), pa.array(score), pa.array(["exact", "semantic", "shingle", "none"]).take(pa.array(method))], ["doc_id", "score", "method"])
        yield self._named(q[begins].tolist(), np.r_[begins[1:], len(q)], lists)


def candidate_lists(queries: DataFrame, corpus: DataFrame, most: int) -> DataFrame:
    """Queries (qid, org_id, tokens, any others) without tokens and with best, array<struct<doc_id, shared>>: the documents that share most distinct tokens, in order.

    corpus: (doc_id, org_id, sentence). Ties: the earlier position of the first shared token, then the smaller id. A query
    that shares no token with any document gets the first `most` that it may see, with shared 0.
    """
    columns = [c for c in queries.columns if c != "tokens"]
    names = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in columns)
    return _met(queries, _blocks(corpus, False), lambda rows: Asking(rows, most), columns, f"{names}, best array<struct<doc_id string, shared bigint>>")


def scored_pairs(queries: DataFrame, corpus: DataFrame, most: int, stop: tuple[str, ...]) -> DataFrame:
    """(qid, org_id, text, best): queries (qid, org_id, text, tokens, normal) with the scores of every sentence of their candidates; several rows for a query."""
    scores = "array<struct<doc_id string, sent_idx int, w double, cos double, sh double, jaccard double>>"
    return _met(queries.withColumn("all", F.col("tokens")), _blocks(corpus, True), lambda rows: Scoring(rows, most, list(stop), None, 0.0), [], f"qid bigint, org_id string, text string, best {scores}")


def best_sources(queries: DataFrame, corpus: DataFrame, most: int, stop: tuple[str, ...], sources: int, threshold: float) -> DataFrame:
    """(qid, org_id, text, best): queries as above with their best `sources` documents of a score over `threshold`, in order."""
    return _met(queries.withColumn("all", F.col("tokens")), _blocks(corpus, True), lambda rows: Scoring(rows, most, list(stop), sources, threshold), [], "qid bigint, org_id string, text string, best array<struct<doc_id string, score double, method string>>")


def _met(queries: DataFrame, blocks: DataFrame, made: Callable[[pa.Table], Asking], columns: list[str], schema: str) -> DataFrame:
    """What each group of queries gives after it met the blocks that it may see, in their order."""
    asked = queries.withColumn("tokens", F.array_distinct("tokens"))
    groups = written(asked.groupBy("org_id").agg(F.ceil(F.count("*") / GROUP).alias("groups")), "groups")
    each = groups.select(F.col("org_id").alias("viewer"), F.explode(F.sequence(F.lit(0), F.col("groups").cast("int") - 1)).alias("g"))
    shared = blocks.where("doc_org = 'global'").crossJoin(each)
    own = blocks.where("doc_org <> 'global'").join(each, F.col("doc_org") == F.col("viewer"))
    mine = asked.join(groups.withColumnRenamed("org_id", "viewer"), F.col("org_id").eqNullSafe(F.col("viewer"))).withColumn("g", F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int")).withColumn("part", F.lit(0)).drop("groups")
    tasks = int(min(2000, 3 * max(1, each.count())))  # a task for each group, nearly; decides about sizes alone
    rows = mine.unionByName(shared.unionByName(own), allowMissingColumns=True).repartition(tasks, "viewer", "g").sortWithinPartitions("viewer", "g", "part", "doc_org", "block")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, asking = None, [], None
        for batch in batches:
            b = pa.table(batch)
            key = pd.MultiIndex.from_arrays([b["viewer"].to_pandas(), b["g"].to_pandas(), b["part"].to_pandas()])
            begins = _runs(key.factorize()[0])
            for s, e in zip(begins, [*begins[1:], len(b)]):
                of, part = (b["viewer"][int(s)].as_py(), b["g"][int(s)].as_py()), b["part"][int(s)].as_py()
                if of != at:
                    if at is not None:
                        yield from (asking or made(pa.concat_tables(held))).best(columns)
                    at, held, asking = of, [], None
                if part == 0:
                    held.append(b.slice(s, e - s).drop_columns(["viewer", "g", "part", "doc_org", "block", "data"]))
                    continue
                asking = asking or made(pa.concat_tables(held))
                for data in b["data"].slice(s, e - s):
                    if part == 1:
                        asking.meet(data.as_py())
                    else:
                        yield from asking.score_block(data.as_py())
        if at is not None:
            yield from (asking or made(pa.concat_tables(held))).best(columns)

    return rows.mapInArrow(met, schema)
