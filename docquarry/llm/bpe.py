"""Byte-pair encoding as a streaming transducer of bounded lookahead, and incremental decoding."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.memos import Memo, only, register
from docquarry.llm.shared import prepare, spare, spread

#: Fixed value: how byte-level vocabularies of this family split text before merging.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
GAP = regex.compile(r"\S\s")
ODD = regex.compile(r"\s ")
#: Characters of a slice, bytes that a merge window settles at once, remembered words.
SLICE, WINDOW, MEMO = 1 << 16, 4096, 200_000
#: Above every rank; and letters below which words are split without a pattern.
NEVER, PLAIN = 1 << 30, "\u0250"


def byte_letters() -> dict[str, int]:
    """letter -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes for U+0100 onwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_kind(spec: dict) -> None:
    """ValueError for a vocabulary file that asks for more than this encoder does: it splits by SPLIT, merges bytes by rank, takes added
    tokens wherever their text stands, and nothing else."""
    model, split, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    wrong = [
        model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        bool(spec.get("normalizer")) or bool(spec.get("post_processor")) and spec["post_processor"].get("type") != "ByteLevel",
        split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True),
        decoder.get("type") != "ByteLevel",
        any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")),
    ]
    if any(wrong):
        raise ValueError("not a plain byte-level vocabulary: its " + ", ".join(n for n, w in zip(("model", "normalizer or post-processor", "pre-tokenizer", "decoder", "added tokens"), wrong, strict=True) if w))


class Vocabulary:
    """Tokens as bytes, merges by rank, special strings, and the merge list's sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_kind(spec)
        letters = byte_letters()
        ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        #: Pair of ids -> rank, and rank -> id of what the pair becomes.
        self.ranks: dict[tuple[int, int], int] = {}
        self.results: list[int] = []
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        encoded = [tuple(bytes(letters[c] for c in side) for side in pair) for pair in pairs]
        for rank, (a, b) in enumerate(encoded):
            self.ranks[ids[a], ids[b]] = rank
            self.results.append(ids[a + b])
        self.lookahead = sufficient_lookahead(encoded)
        #: By id: a token's bytes, and the id as text.
        self.names = [str(i) for i in range(max(self.token_bytes) + 1)]
        self.bytes_of = [self.token_bytes.get(i, b"") for i in range(max(self.token_bytes) + 1)]
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None


def sufficient_lookahead(merges: Sequence[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end on which it can depend that the token stands in the result.

    A token t stops standing only by a merge with the token c on its right, and only at a rank below that of a merge
    that t waits for. c comes about, and is still there, subject to c's own right side at lower ranks; and t itself came
    about because its last part did not merge rightwards before. So along each chain of influence ranks fall and
    the chain reaches the length of c further. One pass over the ranks finds the longest: reach[t] is the largest so
    far of len(c) + (what c depends on) over merges (t, c), and formed[t] what t's last part depended on when t was merged.
    """
    reach: dict[bytes, int] = {}
    formed: dict[bytes, int] = {}
    for a, b in merges:
        on = max(reach.get(b, 0), formed.get(b, 0))
        formed[a + b] = max(formed.get(a + b, 0), on)
        reach[a] = max(reach.get(a, 0), len(b) + on)
    return max([1, *reach.values(), *formed.values()])


class Encoder:
    """Text in pieces of any size -> tokens, each as soon as no further text can change it.

    Memory is bounded by SLICE + WINDOW + lookahead characters and the memos, whatever the text's length: text is taken
    up to the last start of white space (where a split always falls), and within a run that has none, up to the last
    token that is `lookahead` bytes from the end.
    """

    def __init__(self, vocabulary: Vocabulary, memo: int | None = None):
        self.v, self.left = vocabulary, ""
        most = MEMO if memo is None else memo
        #: Stretches, what stands behind a space, and split words, each with its ids.
        self.memo, self.spaced, self.words = Memo(most // 4), Memo(most), Memo(most // 2)
        self.longest_special = max(map(len, vocabulary.special), default=0)

    def merged(self, data: bytes) -> list[int]:
        """The tokens of one split word: merges by rank, the leftmost first."""
        byte_ids, ranks, results = self.v.byte_ids, self.v.ranks, self.v.results
        ids = [byte_ids[b] for b in data]
        if len(ids) < 64:
            waiting = [ranks.get(pair, NEVER) for pair in zip(ids, ids[1:], strict=False)]
            while waiting:
                rank = min(waiting)
                if rank == NEVER:
                    break
                i = waiting.index(rank)
                ids[i] = results[rank]
                del ids[i + 1], waiting[i]
                if i < len(waiting):
                    waiting[i] = ranks.get((ids[i], ids[i + 1]), NEVER)
                if i:
                    waiting[i - 1] = ranks.get((ids[i - 1], ids[i]), NEVER)
            return ids
        n = len(ids)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = results[rank]
            gone[j], after[i] = True, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (rank := ranks.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (rank, left, ids[left], ids[right]))
        return [t for t, x in zip(ids, gone, strict=True) if not x]

    def word(self, data: bytes) -> Iterator[int]:
        """The tokens of one split word of any length, through a window of WINDOW + lookahead bytes."""
        at, ahead = 0, self.v.lookahead
        while len(data) - at > WINDOW + ahead:
            window = data[at : at + WINDOW + ahead]
            end = 0
            for token in self.merged(window):
                size = len(self.v.token_bytes[token])
                if end + size > WINDOW:
                    break
                yield token
                end += size
            at += end
        yield from self.merged(data[at:])

    def split(self, text: str) -> list[str]:
        """The split words of a piece of text. Words of Latin letters, perhaps with a sign behind them, need no pattern."""
        body = text[1:] if text[:1] == " " else text
        if body.isalpha() and max(body) < PLAIN:
            return [text]
        if body[-1:] in ",.!?;:" and body[:-1].isalpha() and max(body) < PLAIN:
            return [text[:-1], text[-1]]
        return SPLIT.findall(text)

    def ids(self, word: str) -> tuple[int, ...]:
        if len(word) >= 64:
            return tuple(self.word(word.encode("utf-8", "surrogatepass")))
        got = self.words.get(word)
        return got if got is not None else self.words.put(word, tuple(self.merged(word.encode("utf-8", "surrogatepass"))))

    def piece(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.ids, self.split(text))))

    def remembered(self, memo: Memo, key: str, text: str) -> tuple[int, ...]:
        got = memo.get(key)
        if got is None:
            got = self.piece(text)
            if len(text) < 64:
                memo.put(key, got)
        return got

    def stretch(self, text: str) -> list[tuple[int, ...]]:
        """The ids of the pieces of text that begins and ends at split places and holds no special string."""
        if ODD.search(text):
            # Runs of white space before a space: find the splits over the whole stretch.
            return list(map(self.ids, SPLIT.findall(text)))
        first, *rest = text.split(" ")
        out = [self.remembered(self.memo, first, first)] if first else []
        found = list(map(self.spaced.young.get, rest))
        if None in found:
            found = [self.remembered(self.spaced, w, " " + w) if got is None else got for got, w in zip(found, rest, strict=True)]
        return out + found

    def settled(self, text: str) -> list[tuple[int, ...]]:
        if not self.v.special or not any(s in text for s in self.v.special):
            return self.stretch(text)
        out = []
        for part in self.v.special_split.split(text):
            if part in self.v.special:
                out.append((self.v.special[part],))
            elif part:
                out += self.stretch(part)
        return out

    def feed(self, text: str) -> list[tuple[int, ...]]:
        """The ids, in pieces, that are settled once text has come."""
        self.left += text
        out = []
        while len(self.left) > SLICE:
            gap = max((m.start() + 1 for m in GAP.finditer(self.left, max(0, SLICE - 4096), SLICE)), default=0)
            if not gap:
                gap = max((m.start() + 1 for m in GAP.finditer(self.left)), default=0)
            if gap:
                out += self.settled(self.left[:gap])
                self.left = self.left[gap:]
                continue
            some = self.unbroken()
            if not some:
                break
            out += some
        return out

    def unbroken(self) -> list[tuple[int, ...]]:
        """Settle the head of a stretch without a gap: words that four others follow, else the stable tokens of a long word."""
        end = len(self.left) - self.longest_special - 16
        if self.v.special and (m := self.v.special_split.search(self.left)):
            if m.start() < SLICE:
                head, self.left = self.left[: m.end()], self.left[m.end() :]
                return self.settled(head)
            end = min(end, m.start())
        words = [m.group() for m in SPLIT.finditer(self.left)]
        at, out = 0, []
        for w in words[:-4]:
            if at + len(w) > end:
                break
            out.append(self.ids(w))
            at += len(w)
        if out:
            self.left = self.left[at:]
            return out
        data = words[0][: min(len(words[0]), end)].encode("utf-8", "surrogatepass")
        whole = words[0].encode("utf-8", "surrogatepass")
        room, ids, size, best = len(data) - self.v.lookahead, [], 0, (0, 0)
        for token in self.word(data):
            size += len(self.v.token_bytes[token])
            if size > room:
                break
            ids.append(token)
            # The rest must be split as it would be here: whole characters, and no apostrophe that could begin a contraction.
            if whole[size] & 0xC0 != 0x80 and whole[size] != 0x27:
                best = (len(ids), size)
        self.left = self.left[len(data[: best[1]].decode("utf-8", "surrogatepass")) :]
        return [tuple(ids[: best[0]])] if best[0] else []

    def finish(self) -> list[tuple[int, ...]]:
        text, self.left = self.left, ""
        return self.settled(text) if text else []


class Decoder:
    """Token ids in pieces of any size -> text: bytes that end within a character wait for the next ones; ill-formed ones become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of, ids)))

    def finish(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


_LOADED: dict[tuple[str, int | None], tuple[Vocabulary, Encoder]] = {}


def loaded(path: str, memo: int | None = None) -> tuple[Vocabulary, Encoder]:
    if (path, memo) not in _LOADED:
        _LOADED.clear()
        vocabulary = Vocabulary(path)
        _LOADED[path, memo] = (vocabulary, Encoder(vocabulary, memo))
    only("bpe")
    return _LOADED[path, memo]


def forget() -> None:
    """Drop vocabulary and memos: what comes next in this worker needs neither."""
    _LOADED.clear()


register("bpe", forget)


def encode(path: str, text: str | None) -> list[int]:
    _, encoder = loaded(path)
    text = text or ""
    pieces = [p for at in range(0, len(text), SLICE) for p in encoder.feed(text[at : at + SLICE])] + encoder.finish()
    return list(chain.from_iterable(pieces))


def round_trip(vocabulary: Vocabulary, encoder: Encoder, text: str) -> tuple[int, str, str]:
    """Number of tokens, SHA-256 of the ids joined by commas, SHA-256 of the decoded text, slice by slice."""
    decoder, n, ids_hash, text_hash = Decoder(vocabulary), 0, hashlib.sha256(), hashlib.sha256()
    starts = range(0, len(text), SLICE)
    for k in range(len(starts) + 1):
        pieces = encoder.feed(text[starts[k] : starts[k] + SLICE]) if k < len(starts) else encoder.finish()
        ids = list(chain.from_iterable(pieces))
        if ids:
            ids_hash.update((("," if n else "") + ",".join(map(vocabulary.names.__getitem__, ids))).encode())
            n += len(ids)
            text_hash.update(decoder.feed(ids).encode("utf-8", "surrogatepass"))
    text_hash.update(decoder.finish().encode("utf-8", "surrogatepass"))
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def digest_udf(name: str, memo: int | None = None):
    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def digest(text: pd.Series) -> pd.DataFrame:
        vocabulary, encoder = loaded(SparkFiles.get(name), memo)
        rows = [round_trip(vocabulary, encoder, t if isinstance(t, str) else "") for t in text]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def encode_udf(name: str):
    @F.pandas_udf("array<int>")
    def encoded(text: pd.Series) -> pd.Series:
        path = SparkFiles.get(name)
        return pd.Series([encode(path, t if isinstance(t, str) else "") for t in text])

    return encoded


def shipped(spark: SparkSession, path: str) -> str:
    """Give the vocabulary file to every executor; returns the name under which it is found."""
    name = path.rsplit("/", 1)[-1]
    if not any(str(f).endswith("/" + name) for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return name


def encode_texts(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """docs with ids, array<int>: each text's tokens (null: none). path: a byte-level BPE vocabulary file of the tokenizers library."""
    prepare(spark)
    return spread(docs).withColumn("ids", encode_udf(shipped(spark, path))("text"))


def encode_decode(spark: SparkSession, docs: DataFrame, path: str, memo: int | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of each whole text, encoded and decoded by streaming. memo: words that a worker
    remembers, MEMO if not told; fewer take less memory and more time.

    The ids are those of the tokenizers library without special tokens added; a special token's string in a text is that
    token. A null text is an empty one: no tokens, the digests of nothing. Rows are independent; extra columns stay, but for those of the same names.
    """
    prepare(spark)
    (digest,) = spare(docs, "digest")
    made = spread(docs).withColumn(digest, digest_udf(shipped(spark, path), memo)("text"))
    own = ("n_tokens", "ids_sha256", "decoded_sha256")
    return made.select(*[f"`{c}`" for c in docs.columns if c not in own], *[f"{digest}.{c}" for c in own])
