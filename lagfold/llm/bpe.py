"""BPE encoding and decoding with a pair occurrence index.

The unseen words of a batch are laid out as one sequence of symbols.  An index maps
each mergeable pair (by its rank) to all its positions; the active ranks are applied
in ascending order, each to its whole list, and the lists that a merge touches are
updated.  Results equal those of the tokenizer file's own library.

Defined cases: a null text is an empty text and has no ids; equal texts have equal
rows; special tokens written out in a text become their ids; a null id stays null; an
empty table gives no rows; other columns are not looked at unless ``keep`` names them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lagfold.llm.text import Words, buffers, tidy



#: The tokenizer's split of lower-case text: fixed pattern; the first is the same on ASCII alone.
_ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: White space to the tokenizer: fixed values, the Unicode property White_Space.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Marks that Unicode has added since the tables by which the tokenizer normalises; it neither moves nor composes them.
_UNMOVED = re.compile(
    "([\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e"
    "\U00011839\U0001183a\U00011930\U0001193d\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44\U00011d45\U00011d97"
    "\U00011f41\U00011f42\U00016ff0\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef])"
)


def normalised(raw: str) -> str:
    """The composed, lower-case form: character by character, so that a last sigma is one like others."""
    return "".join(unicodedata.normalize("NFC", x) for x in _UNMOVED.split(raw)).replace("\u03a3", "\u03c3").lower()


def byte_alphabet() -> list[str]:
    """The printable character of each byte: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


class WordBPE:
    """A word-end BPE tokenizer read from the text of its JSON file."""

    def __init__(self, spec: str, cache_words: int = 250_000, group: int = 5_000):
        self.spec = spec
        spec = json.loads(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.end = model["end_of_word_suffix"]
        self.left, self.right, self.made = [], [], []
        self.rank: dict[int, int] = {}
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y = self.vocab[a], self.vocab[b]
            self.rank.setdefault(x << 32 | y, len(self.left))
            self.left.append(x)
            self.right.append(y)
            self.made.append(self.vocab[a + b])
        alphabet = byte_alphabet()
        self.symbol = np.array([self.vocab[c] for c in alphabet], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in alphabet], np.int64)
        self.pairs = np.array(sorted(self.rank), np.int64)
        self.pair_ranks = np.array([self.rank[int(p)] for p in self.pairs], np.int64)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte = {c: b for b, c in enumerate(alphabet)}
        self.library, self.assigned = None, set()
        self.forget()
        names = [(i, t.encode() + b" ") for i, t in sorted(self.tokens.items())]
        self.row_of = np.zeros(max(self.tokens) + 1, np.int64)
        self.row_of[[i for i, _ in names]] = np.arange(len(names))
        self.spelt = Pieces(np.frombuffer(b"".join(t for _, t in names), np.uint8), np.array([len(t) for _, t in names]))
        self.cache_words, self.group = cache_words, group

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each word has."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        begins = (ends - size).tolist()
        laid = self.symbol[raw]
        laid[ends - 1] = self.last[raw[ends - 1]]
        n = len(raw)
        word_of: list[int] = np.repeat(np.arange(len(words)), size).tolist()
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for k in range(len(words)):
            before[begins[k]] = -1
            after[(begins[k + 1] if k + 1 < len(words) else n) - 1] = -1
        index: dict[int, list[int]] = {}
        rank, left, right, made = self.rank, self.left, self.right, self.made
        if n > 1:  # all pairs at once: rank by binary search, places by rank
            pair = laid[:-1] << 32 | laid[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            found = self.pairs[at] == pair
            found[ends[:-1] - 1] = False
            place = np.flatnonzero(found)
            ranks = self.pair_ranks[at[place]]
            order = np.argsort(ranks, kind="stable")
            place, ranks = place[order], ranks[order]
            cuts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if len(ranks) else ranks
            index = {r: p.tolist() for r, p in zip(ranks[cuts].tolist(), np.split(place, cuts[1:]))} if len(ranks) else {}
        sym: list[int] = laid.tolist()
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            if not (places := index.pop(r, None)):
                continue
            a, b, c = left[r], right[r], made[r]
            held: set[int] = set()  # words in which a lower rank has become active meanwhile
            places.sort()
            for i in places:
                j = after[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue
                if held and word_of[i] in held:
                    index.setdefault(r, []).append(i)
                    continue
                sym[i], sym[j] = c, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (s := rank.get(c << 32 | sym[k])) is not None:
                        if s not in index:
                            index[s] = []
                            heapq.heappush(active, s)
                        index[s].append(i)
                        if s < r:
                            held.add(word_of[i])
                k = before[i]
                if k >= 0 and (s := rank.get(sym[k] << 32 | c)) is not None:
                    if s not in index:
                        index[s] = []
                        heapq.heappush(active, s)
                    index[s].append(k)
                    if s < r:
                        held.add(word_of[i])
            if r in index:
                heapq.heappush(active, r)
        done = np.array(sym, np.int64)
        alive = done >= 0
        return done[alive].astype(np.uint32), np.bincount(np.repeat(np.arange(len(words)), size)[alive], minlength=len(words))

    def pieces(self, raw: str) -> list[bytes]:
        """The pre-tokens of a stretch of text."""
        if raw.isascii():
            return [p.encode() for p in _ASCII_SPLIT.findall(raw.lower())]
        for c in {*raw} - self.assigned:
            if unicodedata.category(c) == "Cn":  # newer than Python's tables
                return self._other_pieces(raw)
            self.assigned.add(c)
        return [p.encode() for p in _SPLIT.findall(normalised(raw))]

    def _other_pieces(self, raw: str) -> list[bytes]:
        """With characters that Python's Unicode version doesn't know yet, the library's own tables decide."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(raw))
        return [bytes(map(self.byte.__getitem__, p)) for p, _ in found]

    def forget(self) -> None:
        """Drop the known words."""
        self.known, self.cached, self.spelling = np.zeros(0, np.uint64), Pieces(np.zeros(0, np.uint32), np.zeros(0, np.int64)), Pieces(np.zeros(0, np.uint8), np.zeros(0, np.int64))

    def learn(self, raw: list[bytes]) -> "Pieces":
        """The ids of stretches of text without ASCII white space."""
        parts = []
        for at in range(0, len(raw), self.group):
            pieces = [self.pieces(x.decode()) for x in raw[at : at + self.group]]
            number: dict[bytes, int] = {}
            order = np.array([number.setdefault(p, len(number)) for ps in pieces for p in ps], np.int64)
            ids, count = self.merge(list(number)) if number else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            each = Pieces(ids, count).take(order)
            own = np.concatenate([[0], np.cumsum([len(ps) for ps in pieces])])
            parts.append(Pieces(each.values, np.diff(each.offsets[own])))
        return Pieces.joined(parts)

    def slow(self, text: str) -> list[int]:
        """The ids of a text that may hold special tokens, without the known words."""
        out: list[int] = []
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            out += [self.special[part]] if k % 2 else self.learn([x.encode() for x in _WHITE.split(part) if x]).values.tolist()
        return out

    def encode(self, column) -> tuple["Pieces", "Pieces"]:
        """The ids of each text of a string column, and the bytes of each decoded text.

        Words are looked up by their hashes and compared by their bytes; a text with a word whose hash is another's is encoded by itself.
        """
        data, offsets = buffers(column)
        words = Words(data, offsets)
        own, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        strange = ~words.equal(np.arange(len(back)), words, first[back])
        at = np.minimum(np.searchsorted(self.known, own), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != own) if len(self.known) else np.arange(len(own))
        old = np.delete(np.arange(len(own)), new)
        if len(old):
            other = np.zeros(len(own), bool)
            other[old] = ~words.equal(first[old], Words.laid(self.spelling.values, self.spelling.offsets), at[old])
            strange |= other[back]
        if len(new):
            whole = data.tobytes()
            raw = [whole[words.starts[i] : words.ends[i]] for i in first[new]]
            got, spelt = self.learn(raw), Pieces(np.frombuffer(b"".join(raw), np.uint8), np.array([len(w) for w in raw], np.int64))
            if len(self.known) + len(new) > self.cache_words:
                self.known, self.cached, self.spelling = own[old], self.cached.take(at[old]), self.spelling.take(at[old])
            known, cached, spelling = np.concatenate([self.known, own[new]]), Pieces.joined([self.cached, got]), Pieces.joined([self.spelling, spelt])
            order = np.argsort(known)
            self.known, self.cached, self.spelling = known[order], cached.take(order), spelling.take(order)
            at = np.searchsorted(self.known, own)
        each = self.cached.take(at[back])
        ids = Pieces(each.values, np.diff(each.offsets[words.of]))
        alone = np.searchsorted(words.of, np.flatnonzero(strange), "right") - 1
        if self.specials is not None:
            alone = np.concatenate([alone, np.searchsorted(offsets, np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)), "right") - 1])
        if len(alone):
            rows = np.split(ids.values, ids.offsets[1:-1])
            for k in np.unique(alone):
                rows[k] = np.array(self.slow(data[offsets[k] : offsets[k + 1]].tobytes().decode()), np.uint32)
            ids = Pieces(np.concatenate(rows), np.array([len(r) for r in rows]))
        text = self.spelt.take(self.row_of[ids.values])
        size = np.diff(text.offsets[ids.offsets])
        some = size > 0
        values = np.delete(text.values, np.cumsum(size)[some] - 1)  # no space after a text's last token
        return ids, Pieces(values, size - some)


class Pieces:
    """Many short arrays laid out as one."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.values, self.offsets = values, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    def take(self, rows: np.ndarray) -> "Pieces":
        count = np.diff(self.offsets)[rows]
        end = np.cumsum(count)
        total = int(end[-1]) if len(end) else 0
        kind = np.int32 if max(total, len(self.values)) < 1 << 31 else np.int64
        place = np.repeat((self.offsets[rows] - end + count).astype(kind), count)
        place += np.arange(total, dtype=kind)
        return Pieces(self.values[place], count)

    @staticmethod
    def joined(parts: list["Pieces"]) -> "Pieces":
        return Pieces(np.concatenate([p.values for p in parts]), np.concatenate([np.diff(p.offsets) for p in parts])) if parts else Pieces(np.zeros(0, np.uint32), np.zeros(0, np.int64))


_LOADED: dict[str, WordBPE] = {}


def tokenizer(spec: str) -> WordBPE:
    """The tokenizer of a file's text; kept by this Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBPE(spec)
    return _LOADED[key]


def encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, decoded: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode each text; one row per row.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and on request
    ``ids`` (array) and ``decoded`` (the text).  ``keep`` names further columns to carry.
    ``spec`` is the text of the tokenizer's JSON file (1.7 MB, sent with the task).
    """
    from pyspark.sql import types as T

    frame = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"), *[docs[c].alias(f"_k{n}") for n, c in enumerate(keep)])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    if decoded:
        schema.add("decoded", T.StringType())
    for c in keep:
        schema.add(c, docs.schema[c].dataType)

    def run(batches):
        bpe = tokenizer(spec)
        for whole in batches:
            at = 0
            sizes = pa.compute.binary_length(whole.column("_text")).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
            while at < whole.num_rows:  # about 1 MB of text at a time
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 1_000_000)))
                batch = whole.slice(at, end - at)
                at = end
                got, text = bpe.encode(batch.column("_text"))
                raw, low = got.values.astype("<u4").tobytes(), text.values.tobytes()
                digest = lambda x, of, w: pa.array([hashlib.sha256(x[a * w : b * w]).hexdigest() for a, b in zip(of.tolist(), of[1:].tolist())], pa.string())
                cols = [batch.column("_id"), pa.array(np.diff(got.offsets)), digest(raw, got.offsets, 4), digest(low, text.offsets, 1)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(got.offsets.astype(np.int32)), pa.array(got.values.astype(np.int32))))
                    names.append("ids")
                if decoded:
                    cols.append(pa.array([low[a:b].decode() for a, b in zip(text.offsets.tolist(), text.offsets[1:].tolist())], pa.string()))
                    names.append("decoded")
                for n, c in enumerate(keep):
                    cols.append(batch.column(f"_k{n}"))
                    names.append(c)
                yield pa.RecordBatch.from_arrays(cols, names)
        bpe.forget()
        tidy()

    return frame.mapInArrow(run, schema)
