"""BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of a word's prefix has one last token, and it is the only token that ends there and goes
together with the last token of the prefix before it. Two tokens go together if no merge crosses their
boundary when the two are encoded as one string, which their merge trees tell. So one pass over a word
stores the last token of every prefix, and the back-pointers give the ids.

Tokens that end at a place come from a suffix automaton of the vocabulary: its state is the longest
suffix read so far that lies in any token, and the suffix links lead to the tokens that are suffixes.

A word is a sequence of atoms: its bytes, of which the last one, that carries the end of the word, is a
byte of its own kind (256 more). Distinct words of a block of texts are encoded side by side, place by
place; those longer than LONG one at a time.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import extended
from .tokens import _byte_alphabet

LONG = 512  # atoms of a word that is encoded by itself
KEPT = 150_000  # words, and chunks, that a worker keeps; it keeps 8 * KEPT of their ids
MEMO_BITS = 19  # pairs of tokens whose answers are kept, as a power of two
SLICE = 1 << 20  # characters of a text that are handled at a time
FINAL = 256  # what a word's last byte has more than others
_NEVER = np.int64(1) << 60

#: Scripts on which Python's tables and the tokenizers library's agree (tests/llm compare every code point); texts with other characters are split by the library.
_SETTLED = "\x00-ͷ΄-ՖḀ-ỿ‐-⁞₠-₿←-⏿☀-⛿ぁ-ゖァ-ヺ一-龥가-힣\U0001f600-\U0001f64f"
_OTHER = regex.compile(f"[^{_SETTLED}]")
_BLANK = regex.compile(r"\s")
_INNER = regex.compile(r"[\x1c-\x1f]")  # Python's split takes these for white space, the vocabulary does not


def suffix_automaton(strings: list[bytes | list[int]]) -> tuple[list[int], list[int], list[dict[int, int]], list[int]]:
    """Suffix links, lengths of the longest strings and transitions of the states, and the state of each whole string. State 0 is the empty string."""
    link, longest, moves, whole = [-1], [0], [{}], []

    def clone(p: int, q: int, c: int) -> int:
        link.append(link[q]), longest.append(longest[p] + 1), moves.append(dict(moves[q]))
        new = link[q] = len(link) - 1
        while p >= 0 and moves[p].get(c) == q:
            moves[p][c] = new
            p = link[p]
        return new

    for string in strings:
        at = 0
        for c in string:
            q = moves[at].get(c)
            if q is not None:
                at = q if longest[q] == longest[at] + 1 else clone(at, q, c)
                continue
            link.append(0), longest.append(longest[at] + 1), moves.append({})
            new, p = len(link) - 1, at
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                link[new] = q if longest[q] == longest[p] + 1 else clone(p, q, c)
            at = new
        whole.append(at)
    return link, longest, moves, whole


_HASH = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Long keys to numbers by hashing with linear probing; -1 stands for absent keys. Keys are not negative."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several that want a slot, the last one has it
            self.values[at[free]] = values[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _HASH >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        held = self.keys[at]
        out = self.values[at]
        left = np.flatnonzero((held != keys) & (held >= 0))
        out[held != keys] = -1
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


class Vocabulary:
    """A vocabulary of merges with word ends, as arrays. Its size follows the vocabulary file, so it can go to every worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], _byte_alphabet()
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.names: list[str | None] = [None] * size
        for name, i in itertools.chain(vocab.items(), self.added.items()):
            self.names[i] = name
        #: The merge that makes a token: its rank, and the two tokens; atoms have rank -1.
        self.made = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])], np.int64)
        x, y, t = pairs.T
        if len(np.unique(t)) < len(t):
            raise ValueError("a token is made by two merges")
        self.made[t], self.left[t], self.right[t] = np.arange(len(t)), x, y
        if not ((self.made[x] < self.made[t]) & (self.made[y] < self.made[t])).all():
            raise ValueError("a merge comes before those of its parts")
        self.size = size
        self.merges = Table(x * size + y, np.arange(len(t)))
        ids, strings = [], []
        for name, i in vocab.items():
            own = name.removesuffix(end)
            atoms = [alphabet[c] for c in own]
            if not atoms:
                continue
            ids.append(i)
            strings.append(atoms[:-1] + [atoms[-1] + FINAL * (own != name)])
        reached = self._reached(t)
        link, longest, moves, whole = suffix_automaton(strings)
        self.link, self.longest = np.array(link, np.int64), np.array(longest, np.int64)
        self.token = np.full(len(link), -1, np.int64)
        for i, state in zip(ids, whole, strict=True):
            if reached[i]:
                self.token[state] = i
        #: The nearest state on the way of suffix links, itself left out, that is a token.
        self.shorter = np.full(len(link), -1, np.int64)
        for state in np.argsort(self.longest, kind="stable").tolist()[1:]:
            up = link[state]
            self.shorter[state] = up if self.token[up] >= 0 else self.shorter[up]
        self.moves = Table(np.array([s * 2 * FINAL + c for s, m in enumerate(moves) for c in m], np.int64), np.array([q for m in moves for q in m.values()], np.int64))
        self.length = np.zeros(size, np.int64)
        self.length[ids] = [len(s) for s in strings]
        self.normalizer, self.splitter = spec["normalizer"], spec["pre_tokenizer"]
        self.path = path

    def _reached(self, tokens: np.ndarray) -> np.ndarray:
        """Which tokens are their own string's encoding: their parts are, and no earlier merge crosses these."""
        own = self.together(self.left[tokens], self.right[tokens], self.made[tokens])
        out = np.ones(self.size, bool)
        for t, ok in zip(tokens.tolist(), own.tolist(), strict=True):  # in order of rank
            out[t] = ok and out[self.left[t]] and out[self.right[t]]
        return out

    def together(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge of a rank under limit crosses the boundary of tokens a and b.

        Merges are taken back from the last to the first: of the two symbols at the boundary that with
        the later merge (of equal ones the right, as the left was merged first) gives way to its part at
        the boundary. A pair of symbols that were there together merges if its rank comes before the
        merge that ended one of them; on a tie the pair further left goes first.
        """
        ok = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), _NEVER) if limit is None else limit.copy()
        while len(open_):
            rank = self.merges.get(a * self.size + b)
            crossed = (rank >= 0) & (rank < limit)
            ok[open_[crossed]] = False
            made_a, made_b = self.made[a], self.made[b]
            go = ~crossed & ((made_a >= 0) | (made_b >= 0))
            open_, a, b, made_a, made_b = open_[go], a[go], b[go], made_a[go], made_b[go]
            undo_a = made_a > made_b
            limit = np.where(undo_a, made_a, made_b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def known_together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As together, with answers kept in a table of a fixed size, in which new ones take the places of old ones."""
        keys = a * self.size + b
        slot = (keys.view(np.uint64) * _HASH >> np.uint64(64 - MEMO_BITS)).view(np.int64)
        seen, fits = self.memo
        out = fits[slot]
        new = np.flatnonzero(seen[slot] != keys)
        if len(new):
            out[new] = self.together(a[new], b[new])
            seen[slot[new]] = keys[new]
            at = seen[slot[new]] == keys[new]  # of several with one slot the last stays
            fits[slot[new[at]]] = out[new[at]]
        return out

    @functools.cached_property
    def memo(self) -> tuple[np.ndarray, np.ndarray]:
        return np.full(1 << MEMO_BITS, -1, np.int64), np.zeros(1 << MEMO_BITS, bool)

    @functools.cached_property
    def tables(self) -> tuple:
        """What one long word is encoded with: transitions and merges as dicts, the rest as lists."""
        as_dict = lambda t: dict(zip(t.keys[t.keys >= 0].tolist(), t.values[t.keys >= 0].tolist(), strict=True))
        return as_dict(self.moves), as_dict(self.merges), *(x.tolist() for x in (self.link, self.longest, self.token, self.shorter, self.made, self.left, self.right))

    @functools.cached_property
    def spelled(self) -> pa.Array:
        return pa.array(self.names, pa.string())

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "tables", "spelled")}

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after another, and how many each has. Words are not empty."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        atoms = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        atoms[ends - 1] += FINAL
        last = np.full(len(atoms), -1, np.int64)
        for i in np.flatnonzero(sizes > LONG).tolist():
            last[ends[i] - sizes[i] : ends[i]] = self._prefixes(atoms[ends[i] - sizes[i] : ends[i]].tolist())
        short = np.flatnonzero(sizes <= LONG)
        short = short[np.argsort(-sizes[short], kind="stable")]
        self._side_by_side(atoms, (ends - sizes)[short], sizes[short], last)
        found, at = [], ends - 1
        who = np.arange(len(words))
        while len(who):
            token = last[at]
            found.append((who, at, token))
            at = at - self.length[token]
            more = at >= (ends - sizes)[who]
            who, at = who[more], at[more]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, tokens = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
        return tokens[np.argsort(places)], np.bincount(np.concatenate([x[0] for x in found]), minlength=len(words))

    def _side_by_side(self, atoms: np.ndarray, starts: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> None:
        """Fills last with the last token of every prefix; words go from the longest to the shortest."""
        state, read = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        n, double = len(starts), 2 * FINAL
        for i in range(int(sizes[0]) if n else 0):
            n = int(np.searchsorted(-sizes, -i, side="left"))  # words with more than i atoms
            state, read, c = state[:n], read[:n], atoms[starts[:n] + i]
            lost = np.arange(n)
            while len(lost):
                to = self.moves.get(state[lost] * double + c[lost])
                hit = to >= 0
                state[lost[hit]] = to[hit]
                read[lost[hit]] += 1
                lost = lost[~hit]
                state[lost] = self.link[state[lost]]
                read[lost] = self.longest[state[lost]]
            ends_here = (self.token[state] >= 0) & (read >= self.longest[state])
            match = np.where(ends_here, state, self.shorter[state])
            left = np.arange(n)
            while len(left):
                at, token = match[left], self.token[match[left]]
                before = i - self.longest[at]
                first = before < 0
                fits = first.copy()
                inner = np.flatnonzero(~first)
                fits[inner] = self.known_together(last[starts[left[inner]] + before[inner]], token[inner])
                last[starts[left[fits]] + i] = token[fits]
                left = left[~fits]
                match[left] = self.shorter[match[left]]

    def _prefixes(self, atoms: list[int]) -> list[int]:
        """The last token of every prefix of one long word."""
        moves, pairs, link, longest, token, shorter, made, left, right = self.tables
        double, size = 2 * FINAL, self.size
        last: list[int] = []
        known: dict[int, bool] = {}

        def together(a: int, b: int) -> bool:
            limit = 1 << 60
            while True:
                if pairs.get(a * size + b, limit) < limit:
                    return False
                if made[a] > made[b]:
                    limit, a = made[a], right[a]
                elif made[b] >= 0:
                    limit, b = made[b] + 1, left[b]
                else:
                    return True

        state = read = 0
        for i, c in enumerate(atoms):
            while (to := moves.get(state * double + c)) is None:
                state = link[state]
                read = longest[state]
            state, read = to, read + 1
            match = state if token[state] >= 0 and read >= longest[state] else shorter[state]
            while (before := i - longest[match]) >= 0:
                key = last[before] * size + token[match]
                if (fits := known.get(key)) is None:
                    if len(known) >= 1 << 16:
                        known.clear()
                    fits = known[key] = together(last[before], token[match])
                if fits:
                    break
                match = shorter[match]
            last.append(token[match])
        return last


class Splitter:
    """Words of a text, as the vocabulary's normaliser and splitter make them, in bytes; added tokens' strings stand for themselves."""

    def __init__(self, vocabulary: Vocabulary):
        spec = vocabulary.normalizer
        kinds = [n["type"] for n in spec["normalizers"]] if spec and spec["type"] == "Sequence" else []
        split = vocabulary.splitter["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"]:
            raise ValueError("the vocabulary splits texts in another way")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if vocabulary.added else None
        self.library = tokenizers.Tokenizer.from_file(vocabulary.path)
        self.bytes = {ord(c): b for c, b in _byte_alphabet().items()}

    def parts(self, text: str) -> Iterator[str]:
        """Slices of bounded size between added tokens, cut before white space, and the added tokens' strings."""
        for k, part in enumerate(self.added.split(text) if self.added else [text]):
            at = 0
            while at < len(part):
                cut = _BLANK.search(part, at + SLICE) if not k % 2 and len(part) - at > SLICE else None
                end = cut.start() if cut else len(part)
                yield part[at:end]
                at = end

    def chunks(self, part: str) -> list[str]:
        """What stands between white space."""
        return _BLANK.split(part) if _INNER.search(part) else part.split()

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk; the library splits those with characters outside the settled scripts."""
        if _OTHER.search(chunk) is None:
            if not chunk.isascii():
                chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # a capital sigma has one small form, wherever it stands
            return self.words.findall(chunk.lower())
        normal = self.library.normalizer.normalize_str(chunk)
        return [bytes(map(self.bytes.__getitem__, map(ord, w))).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]


class Kept:
    """Strings and their ids, one after another, in the order in which they came."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.flat, self.starts = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)

    def find(self, strings: list[str]) -> tuple[np.ndarray, list[str]]:
        """Each string's place, and those that were not known, whose places come next."""
        places = list(map(self.places.get, strings))
        fresh: dict[str, int] = {}
        if None in places:
            n = len(self.places)
            for i, p in enumerate(places):
                if p is None:
                    places[i] = fresh.setdefault(strings[i], n + len(fresh))
        return np.array(places, np.int64), list(fresh)

    def add(self, fresh: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, size = len(self.places), int(self.starts[len(self.places)])
        self.places.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        self.flat, self.starts = grown(self.flat, size + len(ids)), grown(self.starts, n + len(fresh) + 1)
        self.flat[size : size + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(fresh)] = size + np.cumsum(counts)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at the places, one after another, and how many each has."""
        counts = self.starts[places + 1] - self.starts[places]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.starts[places] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], counts

    def full(self) -> bool:
        return len(self.places) > KEPT or self.starts[len(self.places)] > 8 * KEPT


def grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)])


class Encoder:
    """A worker's encoder. It keeps the ids of chunks and words that it has seen, up to a bound, and starts anew beyond it."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.splitter = vocabulary, Splitter(vocabulary)
        self.words = Kept()
        self._forget()

    def _forget(self) -> None:
        self.chunks = Kept()
        added = self.vocabulary.added
        self.chunks.add([f" {name}" for name in added], np.array(list(added.values()), np.int64), np.ones(len(added), np.int64))  # no chunk has a blank

    def _chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        places, fresh = self.chunks.find(chunks)
        if fresh:
            split = [self.splitter.split(c) for c in fresh]
            words = list(itertools.chain.from_iterable(split))
            inner, new = self.words.find(words)
            if new:
                self.words.add(new, *self.vocabulary.encode_words([w.encode() for w in new]))
            ids, counts = self.words.ids(inner)
            total = np.concatenate(([0], np.cumsum(counts)))
            ends = np.cumsum([len(x) for x in split])
            self.chunks.add(fresh, ids, np.diff(total[np.concatenate(([0], ends))]))
            if self.words.full():
                self.words = Kept()
        found = self.chunks.ids(places)
        if self.chunks.full():
            self._forget()
        return found

    def encode_block(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is empty. Slices gather until they hold SLICE characters, and are then encoded."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        chunks: list[str] = []
        owners: list[tuple[int, int]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            ids, counts = self._chunk_ids(chunks)
            ends = np.concatenate(([0], np.cumsum(counts)))
            at = 0
            for row, n in owners:
                if n:
                    out[row].append(ids[ends[at] : ends[at + n]])
                at += n
            chunks.clear(), owners.clear()
            held = 0

        for row, text in enumerate(texts):
            for part in self.splitter.parts(text or ""):
                own = [f" {part}"] if part in self.vocabulary.added else self.splitter.chunks(part)
                chunks += own
                owners.append((row, len(own)))
                held += len(part)
                if held >= SLICE:
                    flush()
        flush()
        return [np.concatenate(parts) if parts else np.zeros(0, np.int32) for parts in out]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_encoders: dict[str, Encoder] = {}


def _worker_encoder(path: str, shared) -> Encoder:
    """A worker's one encoder, which outlives its tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(shared.value)
    return _encoders[path]


def encode_texts(rows: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds the token ids (array<int>) of whole texts as the tokenizers library gives them without special tokens of its own, truncation or padding.
    With decoded_col, also what decode_ids makes of them, in the same pass.

    A null or empty text, or one of white space only, has no ids. Strings of added tokens in a text are
    those tokens. A text is handled in slices, so a worker's memory follows the longest text's ids.
    Repeated rows are encoded each; an empty table stays empty. A column named ids_col or
    decoded_col is replaced; all other columns, or of them only those of keep, are kept as they are. The vocabulary goes to the workers: its size is that of the file.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(path))
    added = [ids_col, *([decoded_col] if decoded_col else [])]
    kept = [c for c in (rows.columns if keep is None else keep) if c.lower() not in {a.lower() for a in added}]
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in kept]
    source = rows.select(*quoted, F.col("`" + text_col.replace("`", "``") + "`").cast("string").alias("_encoded_text"))
    out = extended(rows.select(*quoted).schema, f"`{ids_col}` array<int>" + (f", `{decoded_col}` string" if decoded_col else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(path, shared)
        for batch in batches:
            for part in _bounded(batch):
                ids = encoder.encode_block(part.column(part.num_columns - 1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                decoded = [_decoded(column, encoder.vocabulary.spelled)] if decoded_col else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], column, *decoded], names=out.names)

    return source.mapInArrow(run, out)


def _bounded(batch: pa.RecordBatch, limit: int = 2 * SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about limit bytes of text, or one row, so that ids of a part fit a list column."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _decoded(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    flat = ids.flatten()
    valid = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(names))), flat, pa.scalar(None, pa.int32()))
    counts = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    spelled = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int64()), names.take(valid).cast(pa.large_string()))
    text = pc.binary_join(spelled, pa.scalar(" ", pa.large_string())) if not valid.null_count else pa.array([" ".join(t for t in s if t is not None) for s in spelled.to_pylist()], pa.large_string())
    return text.cast(pa.string())


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of token ids, as the tokenizers library decodes a vocabulary that names no decoder: its tokens' strings, special ones too, with a space between.

    Ids that are null or not in the vocabulary are left out. Null or empty ids give an empty text, and an
    empty table stays empty. A column named text_col is replaced; all other columns are kept as they are.
    """
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary(path))
    kept = [c for c in rows.columns if c.lower() != text_col.lower()]
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in kept]
    source = rows.select(*quoted, F.coalesce(F.col("`" + ids_col.replace("`", "``") + "`").cast("array<int>"), F.array().cast("array<int>")).alias("_decoded_ids"))
    out = extended(rows.select(*quoted).schema, f"`{text_col}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.spelled
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _decoded(batch.column(batch.num_columns - 1), names)], names=out.names)

    return source.mapInArrow(run, out)
