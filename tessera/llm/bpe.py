"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a text's prefix is fixed by its last token and the encoding of what stands before that
token.  So a trie node (a prefix of some word) needs one state, its last token: the one vocabulary entry
ending there that BPE leaves unmerged with the last token of the prefix before it.  A task's distinct
words are put in order, which is the order of a depth-first walk through their trie; the states on the
stack up to the common prefix of two neighbours are kept, so a shared prefix is worked out once.

Whether two neighbouring tokens stay apart is found by undoing their merges along the seam, latest
first, and remembered.

Null and empty texts encode to no tokens.  The vocabulary file's path is a parameter.  The cache of
encoded words has two generations of fixed size, so memory follows neither corpus nor text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K

#: How byte-level BPE splits a text before merging (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern means it: Unicode's White_Space, without the separators 0x1C to 0x1F.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Words in each of two generations that a worker remembers, and pairs of tokens.
CACHE_WORDS, CACHE_PAIRS = 300_000, 1_000_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)})
    return out


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file in the ``tokenizers`` format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_letters()
        as_bytes = lambda t: bytes(byte_of[c] for c in t)
        self.id_of = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        for k, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = self.id_of[as_bytes(left)], self.id_of[as_bytes(right)]
            whole = self.id_of[as_bytes(left + right)]
            self.rank[a, b], self.made[a, b] = k, whole
            self.parts.setdefault(whole, (a, b))
        self.step = {t: self.rank[p] for t, p in self.parts.items()}  # when a token comes to be
        self.decode_of = {i: b for i, b in self.bytes_of.items()} | {i: t.encode() for t, i in self.special.items()}


class Encoder:
    """Encodes words; one lives in each Python worker."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.word_pattern = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:(?!{_SPACE})[^\p{{L}}\p{{N}}])").replace(r"\s+(?!\S)", rf"{_SPACE}+(?!(?!{_SPACE})[\s\S])").replace(r"\s+", rf"{_SPACE}+"))
        self.special_pattern = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(v.special, key=len, reverse=True))) if v.special else None
        self.cache: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole_of: dict[int, bool] = {}
        self._build_suffixes()
        self.bytes_of_text = {str(i): b for i, b in v.decode_of.items()}

    def _build_suffixes(self) -> None:
        """An Aho-Corasick automaton of the tokens: ``go[state << 8 | byte]``, and for each state the tokens
        that end there with their lengths, longest first."""
        go: dict[int, int] = {}
        at_state: list[int | None] = [None]
        depth = [0]
        for b, t in self.vocabulary.id_of.items():
            s = 0
            for x in b:
                k = s << 8 | x
                s = go.get(k, -1)
                if s < 0:
                    s = go[k] = len(at_state)
                    at_state.append(None)
                    depth.append(depth[k >> 8] + 1)
            at_state[s] = t
        self.fail, self.ending = [0] * len(at_state), [()] * len(at_state)
        self.go = go
        for k, s in sorted(go.items(), key=lambda e: depth[e[1]]):
            parent = k >> 8
            if parent:
                f = self.fail[parent]
                while f and (f << 8 | k & 255) not in go:
                    f = self.fail[f]
                self.fail[s] = go.get(f << 8 | k & 255, 0)
            own = ((at_state[s], depth[s]),) if at_state[s] is not None else ()
            self.ending[s] = own + self.ending[self.fail[s]]

    def _step(self, state: int, byte: int) -> int:
        """The transition by ``byte``, remembered once it is found over suffixes."""
        f = state
        while f and (f << 8 | byte) not in self.go:
            f = self.fail[f]
        self.go[state << 8 | byte] = found = self.go.get(f << 8 | byte, 0)
        return found

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether BPE over the bytes of a and b ends in exactly a, b."""
        known = self.apart.get((a, b))
        if known is None:
            v = self.vocabulary
            known, last = True, len(v.rank) + 1
            x, y = a, b
            while True:
                seam = v.rank.get((x, y))
                # A merge over the seam comes about if it is due before the merge that took x or y away.
                if seam is not None and seam < last:
                    known = False
                    break
                sx, sy = v.step.get(x, -1), v.step.get(y, -1)
                if sx < 0 and sy < 0:
                    break
                if sx > sy:  # x came to be later: before that, its right half stood at the seam
                    last, x = sx, v.parts[x][1]
                else:  # of equal merges the left one comes first, so the seam's is due before y's
                    last, y = sy + 1, v.parts[y][0]
            self.apart[a, b] = known
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, str]:
        """Comma-joined ids of each word."""
        pairs = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words)
        go, ending, apart, stay_apart, whole = self.go, self.ending, self.apart, self.stay_apart, self.whole
        token: list[int] = [0]  # token[i]: last token of the first i bytes
        back: list[int] = [0]  # back[i]: where that token starts
        state: list[int] = [0]  # state[i]: the longest suffix of these bytes that some token starts with
        before, out = b"", {}
        for word, text in pairs:
            n, k = len(word), 0
            most = min(n, len(before))
            if word[:most] == before[:most]:
                k = most
            else:
                while word[k] == before[k]:
                    k += 1
            del token[k + 1 :], back[k + 1 :], state[k + 1 :]
            s = state[k]
            for i in range(k + 1, n + 1):
                s, last = go.get(s << 8 | word[i - 1], -1), s
                if s < 0:
                    s = self._step(last, word[i - 1])
                for t, size in ending[s]:
                    if size == i:
                        if whole(t):
                            break
                        continue
                    pair = (token[i - size], t)
                    ok = apart.get(pair)
                    if ok is None:
                        ok = stay_apart(*pair)
                    if ok:
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                token.append(t)
                back.append(i - size)
                state.append(s)
            ids, at = [], n
            while at:
                ids.append(token[at])
                at = back[at]
            out[text] = ",".join(map(str, reversed(ids)))
            before = word
        return out

    def whole(self, t: int) -> bool:
        """Whether merging a token's bytes in order of rank gives that token."""
        known = self.whole_of.get(t)
        if known is None:
            v = self.vocabulary
            ids = [v.id_of[bytes([b])] for b in v.bytes_of[t]]
            while len(ids) > 1:
                rank, k = min((v.rank.get(p, len(v.rank)), k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
                if rank == len(v.rank):
                    break
                ids[k : k + 2] = [v.made[ids[k], ids[k + 1]]]
            known = self.whole_of[t] = ids == [t]
        return known

    def pieces(self, text: str) -> list[str]:
        """Words of a text; special tokens stand as themselves."""
        if not self.special_pattern or not any(s in text for s in self.vocabulary.special):
            return self.word_pattern.findall(text)
        out: list[str] = []
        for part in self.special_pattern.splititer(text):
            if part is None:
                continue
            out += [part] if part in self.vocabulary.special else self.word_pattern.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[str]:
        """Comma-joined ids of each text."""
        pieces = [self.pieces(t) for t in texts]
        new = set().union(*pieces) - self.cache.keys()
        if len(self.cache) + len(new) > CACHE_WORDS:  # what is in use stays for another generation
            self.old, self.cache = self.cache, {}
            new = set().union(*pieces)
        for w in [w for w in new if w in self.old]:
            self.cache[w] = self.old[w]
            new.discard(w)
        if len(self.apart) > CACHE_PAIRS:
            self.apart.clear()
        for s, i in self.vocabulary.special.items():
            self.cache[s] = str(i)
            new.discard(s)
        self.cache.update(self.encode_words(new))
        get = self.cache.__getitem__
        return [",".join(map(get, p)) for p in pieces]

    def decode(self, ids: str) -> str:
        """The text of comma-joined ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of_text.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` and, with ``keep_ids``, ``ids array<int>`` and ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for a, b in K.chunks(batch.column(1)):
                ids = e.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                back = [e.decode(x) for x in ids]
                columns = [batch.column(0).slice(a, b - a), pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back])]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array([[int(i) for i in x.split(",")] if x else [] for x in ids], pa.list_(pa.int32())), pa.array(back, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)``: the tokens alone, without what ``encoded`` works out about them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for a, b in K.chunks(batch.column(1), 1 << 20):
                ids = e.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                ends = np.cumsum([0, *(x.count(",") + 1 if x else 0 for x in ids)]).astype(np.int32)
                flat = np.fromstring(",".join(x for x in ids if x), np.int32, sep=",") if ends[-1] else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, ids array<int>")
