"""LM scoring with a sharded Elias-Fano n-gram trie.

Words are cut into blocks of about ``block_tokens`` tokens.  Shards are ranges of the order
of n-grams by the hashes of their first two words: a range of first words mostly, a part of
a frequent word's n-grams where a word alone would fill a shard.  Their number follows the
bytes of the texts.  A block sends to each shard, once, the different n-grams of its range,
with their counts in training texts; it keeps its token sequence aside.  A shard merges what
all blocks sent, builds its trie (interpolated absolute discounting, quantised), maps it to
memory, looks up every n-gram and answers each block.  The answers and the sequences meet
again by block, where the texts are scored.  Neither the vocabulary nor the model ever is in
one place, and what moves grows with the different n-grams of blocks, not with tokens.

p(w | u) = (c(u w) - D) / c(u) + D T(u) / c(u) p(w), and p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),
so the model's probabilities sum to one but for the rounding of the codebooks.

Defined cases: null, empty and blank texts are the end token alone; repeated rows are
scored each (and counted each, in training); rows with a null id are training rows;
an empty table gives no rows; other columns are not looked at.  A first word is known by a
63-bit hash of its bytes, a later one by 32 bits of it (40 after a word that is frequent
enough to have shards of its own), compared with the words seen in the same context only:
another word than these is taken for one of them with a chance of 1e-4 at most.
"""


from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfold.llm.eliasfano import ABSENT, MappedTrie, Trie
from lagfold.llm.spark import cut
from lagfold.llm.text import Words, buffers, mix64, tidy

U = np.uint64
END, START = (int(mix64(np.array([x], U))[0] >> U(1)) for x in (0x656E64, 0x7374617274))
#: Bytes of text for each shard, and rows of the sample that says which words are frequent: they lay out the shards and leave the results alone.
SHARD_BYTES, LAYOUT_ROWS = 4 << 20, 20_000


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    body, head = [], [len(arrays)]
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [len(a), a.dtype.itemsize, ord(a.dtype.kind)]
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    raw = struct.pack(f"<{len(head)}q", *head) + b"".join(body)
    return struct.pack("<q", len(raw)) + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], struct.unpack("<q", blob[:8])[0], asbytes=True)
    (n,) = struct.unpack_from("<q", raw)
    head = struct.unpack_from(f"<{3 * n}q", raw, 8)
    at, out = 8 + 24 * n, []
    for k in range(n):
        length, width, kind = head[3 * k : 3 * k + 3]
        plane = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(np.dtype(f"{chr(kind)}{width}")))
        at += length * width
    return out


class Block:
    """The n-grams of some texts: word numbers by hash order, and at each length the nodes and each token's node."""

    def __init__(self, n1: int, start: int, token: np.ndarray, count: np.ndarray, order: int):
        """``n1``: number of words, of which ``start`` opens a text; ``token``: word of each token; ``count``: tokens of each text."""
        depth = (np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        context = np.where(depth == 0, start, np.roll(token, 1)).astype(np.int32)
        self.nodes, self.of, self.context = [], [], []
        for k in range(2, order + 1):
            use = np.flatnonzero(depth >= k - 2).astype(np.int32)
            own, back = np.unique(context[use].astype(np.int64) * n1 + token[use], return_inverse=True)
            self.nodes.append(((own // n1).astype(np.int32), (own % n1).astype(np.int32)))
            node = np.full(len(token), -1, np.int32)
            node[use] = back
            del own, back
            self.of.append(node)
            self.context.append(np.where(depth >= k - 2, context, -1))
            context = np.roll(node, 1)


class Layout:
    """The shards' first keys: pairs of hashes of the first and the second word, ascending, from (0, 0)."""

    def __init__(self, shards: int, hot: list[tuple[int, float]]):
        """``hot``: frequent words with their shares of all tokens; one that has half a shard or more is cut into parts."""
        keys, own = {(k * (1 << 63) // shards, 0) for k in range(shards)}, set()
        for word, share in hot:
            parts = int(share * shards * 2)
            if parts:
                own.add(word)
                keys |= {(word, t * (1 << 63) // parts) for t in range(parts)} | {(word + 1, 0)}
        keys = sorted(keys)
        self.first, self.second = (np.array([k[j] for k in keys], U) for j in (0, 1))
        #: whether a shard holds n-grams of one frequent word
        self.hot = np.array([k[0] in own for k in keys])

    def __len__(self) -> int:
        return len(self.first)

    def cuts(self, words: np.ndarray, parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each shard's words and pairs begin, of sorted ``words`` and pairs; and whether it begins within a word's pairs.  One more entry closes the last."""
        at = np.searchsorted(words, self.first)
        within = (self.second > 0) & (at < len(words))
        within[within] = words[at[within]] == self.first[within]
        pair = np.searchsorted(parent, at)
        for s in np.flatnonzero(within):
            end = int(np.searchsorted(parent, at[s] + 1))
            pair[s] += np.searchsorted(word[pair[s] : end], np.searchsorted(words, self.second[s]))
        return np.append(at, len(words)), np.append(pair, len(parent)), np.append(within, False)


def _block_rows(ids, hashes, counts, train, number: int, order: int, layout: Layout):
    """The rows that one block sends: a message to each shard, and its own sequence (shard -1 - number)."""
    count = np.concatenate(counts)
    learn = np.concatenate(train)
    words, token = np.unique(np.concatenate([*hashes, np.array([START], U)]), return_inverse=True)
    token = token[:-1].astype(np.int32)
    use = np.repeat(learn, count)
    start = int(np.searchsorted(words, U(START)))
    block = Block(len(words), start, token, count, order)
    c1 = np.bincount(token[use], minlength=len(words))
    c1[start] = int(learn.sum())  # as a context
    edges, pairs, within = layout.cuts(words, *block.nodes[0])
    spans = [edges, pairs]
    for parent, _ in block.nodes[1:]:
        spans.append(np.searchsorted(parent, spans[-1]))
    cs = [np.bincount(node[use & (node >= 0)], minlength=len(parent)).astype(np.uint32) for (parent, _), node in zip(block.nodes, block.of)]
    for s in np.flatnonzero(np.diff(edges) + within[1:] > 0).tolist():
        a, b = edges[s], edges[s + 1] + within[s + 1]  # a word cut in two goes to both
        own = [slice(spans[k][s], spans[k][s + 1]) for k in range(1, order)]
        parts = [np.array([within[s]], np.uint8), words[a:b], c1[a:b].astype(np.uint32)]
        low, high = a, b
        for (parent, word), x, c in zip(block.nodes, own, cs):
            w = words[word[x]]
            more = (w >> U(32) & U(0xFF)).astype(np.uint8) if layout.hot[s] else np.zeros(0, np.uint8)
            parts += [np.bincount(parent[x] - low, minlength=high - low).astype(np.uint32), (w & U(0xFFFFFFFF)).astype(np.uint32), more, c[x]]
            low, high = x.start, x.stop
        yield s, number, pack(*parts)
    # the sequence by falling frequency of the block's words, so that most numbers are small
    by_use = np.argsort(-np.bincount(token, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[by_use] = np.arange(len(words), dtype=np.uint32)
    known = np.concatenate([x.is_valid().to_numpy(zero_copy_only=False) for x in ids])
    yield -1 - number, number, pack(np.array([len(words), start]), by_use.astype(np.uint32), rank[token], count.astype(np.uint32), known.astype(np.uint8), np.concatenate([x.fill_null(0).to_numpy() for x in ids]))


def _answer(rows: list[tuple[int, bytes]], shard: int, order: int, discount: float):
    """Merge the messages of one shard, build and map its trie, look all n-grams up; an answer for each block."""
    sent = [unpack(blob) for _, blob in rows]
    words, inv = np.unique(np.concatenate([p[1] for p in sent]), return_inverse=True)
    c = np.bincount(inv, np.concatenate([p[2] for p in sent])).astype(np.int64)
    later = [np.concatenate([p[4 + 4 * k].astype(U) | (p[5 + 4 * k].astype(U) << U(32) if len(p[5 + 4 * k]) else U(0)) for p in sent]) for k in range(order - 1)]
    vocab, place = np.unique(np.concatenate(later), return_inverse=True)
    place = np.split(place.astype(np.int32), np.cumsum([len(w) for w in later])[:-1])
    del later
    width = max(1, len(vocab))
    merged, levels, keep, parent_inv = [], [], np.arange(len(words)), inv
    for k in range(order - 1):
        parent = np.repeat(parent_inv.astype(np.int64), np.concatenate([p[3 + 4 * k] for p in sent]))
        key, back = np.unique(parent * width + place[k], return_inverse=True)
        count = np.bincount(back, np.concatenate([p[6 + 4 * k] for p in sent])).astype(np.int64)
        merged.append(((key // width).astype(np.int32), (key % width).astype(np.int32), back.astype(np.int32)))
        seen = count > 0  # only what training texts hold is in the trie
        levels.append((keep[key // width][seen], (key % width)[seen], count[seen]))
        keep = np.where(seen, np.cumsum(seen) - 1, -1)
        parent_inv = merged[-1][2]
        del parent, key, back
    trie = MappedTrie(Trie.arrays(words, c, vocab, levels, discount))
    node = trie.words.find(words)
    rank = trie.vocab.find(vocab)
    kinds = np.bincount(levels[0][0], minlength=len(words)).astype(np.uint32)
    found = [(trie.counts[node].astype(np.uint32), trie.backoff[0][0][node], kinds)]
    for k, (parent, word, _) in enumerate(merged):
        node = trie.child(k, node[parent], rank[word])
        ok = node >= 0
        pick = lambda codes: np.where(ok, codes[np.maximum(node, 0)], ABSENT).astype(np.uint8) if len(codes) else np.full(len(node), ABSENT, np.uint8)
        prob = trie.levels[k][2] if k < len(trie.levels) else np.zeros(0, np.uint8)
        back = trie.backoff[k + 1][0] if k + 1 < len(trie.backoff) else np.zeros(0, np.uint8)
        found.append((pick(prob), pick(back)))
    books = [trie.backoff[0][1]]
    for k in range(order - 1):
        books += [trie.levels[k][3] if k < len(trie.levels) else np.zeros(0), trie.backoff[k + 1][1] if k + 1 < len(trie.backoff) else np.zeros(0)]
    # a word cut in two is counted by the shard where it begins
    mine = np.ones(len(words), bool)
    for p in sent:
        if p[0][0]:
            mine[np.searchsorted(words, p[1][0])] = False
    told = mine & (c > 0) & (words != U(START))
    vs, ns = int(told.sum()), int(c[told].sum())
    at = [0] * order
    for n, (block, _) in enumerate(rows):
        p = sent[n]
        sizes = [len(p[1])] + [len(p[4 + 4 * k]) for k in range(order - 1)]
        own = [inv[at[0] : at[0] + sizes[0]]] + [merged[k][2][at[k + 1] : at[k + 1] + sizes[k + 1]] for k in range(order - 1)]
        at = [a + s for a, s in zip(at, sizes)]
        edge = np.zeros(sizes[0], bool)
        edge[[0, -1]] = True  # only they can be cut
        parts = [p[0], found[0][0][own[0]], found[0][1][own[0]], np.where(edge, found[0][2][own[0]], 0).astype(np.uint32)]
        for k in range(1, order):
            parts += [found[k][0][own[k]]] + ([found[k][1][own[k]]] if k < order - 1 else [])
        yield shard, block, vs if n == 0 else 0, ns if n == 0 else 0, pack(*parts, *[b.astype(np.float32) for b in books])


def _finish(answers: list[bytes], plan: bytes, order: int, discount: float, total: int, kinds: int):
    """Scores of a block's texts: (ids, whether they are ids, n_tokens, n_known, base, score)."""
    meta, by_use, t, count, known, ids = unpack(plan)
    n1, start = map(int, meta)
    token = by_use.astype(np.int32)[t]
    del t
    got = [unpack(a) for a in answers]
    n_parts = 2 * order + 1  # arrays before the codebooks: flag, counts, back-off, kinds, then (probability, back-off) but for the last length
    c1 = np.concatenate([g[1][g[0][0] :] for g in got]).astype(np.float64)

    def decoded(k_array: int, k_book: int, cut: bool = False) -> np.ndarray:
        """Values in log10 of one array over all shards; NaN where absent."""
        out = []
        for g in got:
            book = np.append(g[n_parts + k_book].astype(float), np.nan)
            codes = g[k_array][g[0][0] :] if cut else g[k_array]
            out.append(book[np.where(codes == ABSENT, len(book) - 1, codes)])
        return np.concatenate(out) if out else np.zeros(0)

    p1 = (c1 + 0.5) / (total + 0.5 * (kinds + 1))
    lam = _with_cut_words(decoded(2, 0, True), c1, got, discount)
    block = Block(n1, start, token, count.astype(np.int64), order)
    p = p1[token]
    for k in range(order - 1):
        node, context = block.of[k], block.context[k]
        use = np.flatnonzero(node >= 0)
        alpha = decoded(4 + 2 * k, 1 + 2 * k)[node[use]]
        weight = lam[context[use]]
        p[use] = np.where(np.isnan(alpha), 0.0, 10.0**alpha) + np.where(np.isnan(weight), 1.0, 10.0**weight) * p[use]
        if k + 1 < order - 1:
            lam = decoded(5 + 2 * k, 2 + 2 * k)
    text = np.repeat(np.arange(len(count)), count)
    n = len(count)
    return ids, known.astype(bool), count.astype(np.int64), np.bincount(text, c1[token] > 0, n).astype(np.int64), np.bincount(text, np.log10(p1[token]), n), np.bincount(text, np.log10(p), n)


def _with_cut_words(lam: np.ndarray, c1: np.ndarray, got: list, discount: float) -> np.ndarray:
    """Back-off weights with those of words whose pairs lie in several shards: the different successors are the parts' together."""
    at, kinds = 0, {}
    for a, b in zip(got, [*got[1:], None]):
        if a[0][0]:
            kinds[at - 1] = kinds.get(at - 1, 0) + int(a[3][0])
        at += len(a[1]) - int(a[0][0])
        if b is not None and b[0][0] and (len(a[1]) > 1 or not a[0][0]):
            kinds[at - 1] = int(a[3][-1])
    for word, n in kinds.items():
        lam[word] = np.log10(discount * n / c1[word]) if n and c1[word] else np.nan
    return lam


def _layout(source: DataFrame, shards: int | None) -> Layout:
    """The shards, by the bytes and the frequent words of a sample of about LAYOUT_ROWS rows."""
    rows = source.count()
    share = min(1.0, LAYOUT_ROWS / max(rows, 1))

    def count(batches):
        for b in batches:
            data, offsets = buffers(b.column("_text"))
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (4 << 20), "right")) - 1)
                w = Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                own, n = np.unique(np.concatenate([w.hashes() >> U(1), np.repeat(U(START), end - at)]), return_counts=True)
                often = np.flatnonzero(n >= n.sum() / 5000)  # 5000 words at most
                yield pa.RecordBatch.from_arrays([pa.array(np.append(own[often], U(0)).view(np.int64)), pa.array(np.append(n[often], n.sum())), pa.array(np.append(np.zeros(len(often), np.int64), len(w.data)))], ["word", "n", "bytes"])
                at = end

    sample = source if share == 1.0 else source.sample(share, seed=7)
    got = sample.select("_text").mapInArrow(count, "word long, n long, bytes long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    top = got.orderBy(F.col("word") != 0, F.desc("n")).limit(2000).collect()
    held = next((r for r in top if r.word == 0), None)
    if held is None:
        return Layout(shards or 1, [])
    shards = shards or max(1, -(-int(held.bytes / share) // SHARD_BYTES))
    return Layout(shards, [(r.word, r.n / held.n) for r in top if r.word != 0])


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", order: int = 3, discount: float = 0.75, block_tokens: int = 2_200_000, shards: int | None = None) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` of each row; ``train``: a boolean column of ``docs``.

    ``id_col`` must be an integer column.  ``shards`` follows the bytes of the texts unless given.
    """
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.coalesce(train, F.lit(True)).alias("_train"), F.spark_partition_id().cast("long").alias("_part"))
    layout = _layout(source, shards)

    def split(batches):
        ids, hashes, counts, learn, size, turn, part = [], [], [], [], 0, 0, 0

        def flush():
            """Messages in batches of about 8 MB."""
            out, held = [], 0
            for r in _block_rows(ids, hashes, counts, learn, part << 24 | turn, order, layout):
                out.append(r)
                held += len(r[2])
                if held > 8 << 20:
                    yield batch(out)
                    out, held = [], 0
            if out:
                yield batch(out)
            for x in (ids, hashes, counts, learn):
                x.clear()

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "block", "blob"])

        for b in batches:
            data, offsets = buffers(b.column("_text"))
            part = b.column("_part")[0].as_py() if b.num_rows else part
            flag = b.column("_train").to_numpy(zero_copy_only=False).astype(bool)
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (2 << 20), "right")) - 1)
                w = Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                hashes.append(np.insert(w.hashes() >> U(1), w.of[1:], U(END)))
                counts.append(w.counts() + 1)
                ids.append(b.column("_id").slice(at, end - at))
                learn.append(flag[at:end])
                size += len(hashes[-1])
                at = end
                if size >= block_tokens:
                    yield from flush()
                    size, turn = 0, turn + 1
        if size:
            yield from flush()
        tidy()

    sent = source.mapInArrow(split, "shard long, block long, blob binary")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["shard"].iloc[0])
        cols = ["shard", "block", "v", "n", "blob"]
        if s < 0:  # a block's own sequence
            return pd.DataFrame({"shard": pdf["shard"], "block": pdf["block"], "v": 0, "n": 0, "blob": pdf["blob"]})[cols]
        pdf = pdf.sort_values("block")
        return pd.DataFrame(list(_answer(list(zip(pdf["block"], pdf["blob"])), s, order, discount)), columns=cols)

    met = cut(sent.groupBy("shard").applyInPandas(merge, "shard long, block long, v long, n long, blob binary"))
    sums = met.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    kinds, total = int(sums.v or 0), int(sums.n or 0)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        own = pdf["shard"] < 0
        ids, known, n, n_known, base, got = _finish(list(pdf["blob"][~own]), pdf["blob"][own].iloc[0], order, discount, total, kinds)
        return pd.DataFrame({id_col: pd.arrays.IntegerArray(ids.astype(np.int64), ~known), "n_tokens": n, "n_known": n_known, "train_tokens": total, "base_score": base, "score": got})

    schema = T.StructType([T.StructField(id_col, T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return met.select("shard", "block", "blob").groupBy("block").applyInPandas(finish, schema)
