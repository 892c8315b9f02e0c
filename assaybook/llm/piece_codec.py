"""SentencePiece encoding and decoding by a table of every prefix's last token.

The merges of a text are never replayed. For each prefix of a segment there is one token that its
encoding ends with: the piece that ends there and may follow the last token of the prefix before
it. Pieces that end at a position are the matches of the vocabulary's automaton; whether two
tokens may stand side by side is decided from their merge trees alone. The ids then come from
walking back from the last prefix. All new segments of a batch of texts go through each step
together, as numpy arrays.

Pieces hold the space mark only at their front and never a line feed, so a text falls into
segments that never merge with each other, and a segment met before is looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import small_batches, text_slices, whole_text
from .token_counts import PairTable

MARK = "▁"                          # stands for a space inside pieces
#: Segments a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: Pairs of tokens whose compatibility a worker remembers: 2 to this power.
MEMORY_BITS = 20
_LATE = np.int32(np.iinfo(np.int32).max)


class PieceVocabulary:
    """Pieces, their merge trees and their automaton, from a model file of the BPE kind."""

    def __init__(self, path: str):
        import sentencepiece

        self.memory = None

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.byteless = max(self.byte_of, default=-1) + 1          # ids from here on are no bytes
        self.unknown = model.unk_id()
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        self.shown[self.unknown] = " \u2047 "                     # fixed value: how the library shows it
        for i in range(size):
            if model.is_control(i):
                self.shown[i] = ""
        if any(MARK in self.pieces[i].lstrip(MARK) or "\n" in self.pieces[i] for i in plain):
            raise ValueError("pieces must hold the space mark only at their front, and no line feed")
        self.ids = {self.pieces[i]: i for i in plain}
        # letters without a piece of their own still take part in merges
        letters = sorted({c for p in self.ids for c in p} - set(self.ids))
        symbols = self.pieces + letters
        self.stray = len(symbols)        # any other letter: merges with nothing
        code = self.ids | {c: size + k for k, c in enumerate(letters)}
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        self.rank = np.full(self.stray + 1, _LATE, dtype=np.int32)
        for i in plain:
            self.rank[i] = order[model.get_score(i)]
        splits = [(code[p[:k]], code[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in code and p[k:] in code]
        splits = np.array(splits, dtype=np.int64).reshape(len(splits), 3)
        self.merges = PairTable(splits[:, :2], splits[:, 2])
        joined = {(a, b): c for a, b, c in splits.tolist()}
        self.left, self.right = np.full(self.stray + 1, -1, np.int32), np.full(self.stray + 1, -1, np.int32)
        reached = np.zeros(self.stray + 1, dtype=bool)
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            reached[i] = self._derive([code[c] for c in p], i, joined)
        self.length = np.array([len(s) for s in symbols] + [1], dtype=np.int64)
        self._automaton(reached)
        letter = {ord(c): s for c, s in code.items() if len(c) == 1}
        top = max(letter, default=0) + 1
        self.letter = np.full(top + 1, self.stray, dtype=np.int32)       # the last place is for all beyond
        self.letter[list(letter)] = list(letter.values())

    def _derive(self, run: list[int], piece: int, joined: dict) -> bool:
        """Merge the letters of a piece; if they end as that piece, note its last merge."""
        last = (-1, -1)
        while len(run) > 1:
            offers = [(self.rank[joined[p]], k) for k, p in enumerate(zip(run, run[1:])) if p in joined]
            if not offers:
                return False
            _, k = min(offers)
            last = (run[k], run[k + 1])
            run[k : k + 2] = [joined[last]]
        if run[0] != piece:
            return False
        if last[0] >= 0:
            for part in last:
                if self.left[part] >= 0 and self.rank[part] > self.rank[piece]:
                    raise ValueError("a piece is merged before one of its parts")
            self.left[piece], self.right[piece] = last
        return True

    def _automaton(self, reached: np.ndarray) -> None:
        """A trie of all pieces: (state, code point) to state, and the piece that each state completes."""
        step: dict[tuple[int, int], int] = {}
        ends = [-1]
        for p, i in self.ids.items():
            if not reached[i]:
                continue
            state = 0
            for c in p:
                at = (state, ord(c))
                if at not in step:
                    step[at] = len(ends)
                    ends.append(-1)
                state = step[at]
            ends[state] = i
        self.steps = PairTable(np.array(list(step), dtype=np.int64).reshape(len(step), 2), np.array(list(step.values()), dtype=np.int64))
        self.ends = np.array(ends, dtype=np.int32)

    def may_follow(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """``compatible`` through a direct-mapped memory of pairs; a worker has one per task."""
        if self.memory is None:
            self.memory = np.full(1 << MEMORY_BITS, -1, dtype=np.int64), np.zeros(1 << MEMORY_BITS, dtype=bool)
        keys, fits = self.memory
        pair = (before.astype(np.int64) << 32) | after
        slot = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMORY_BITS)).astype(np.int64)
        out = fits[slot]
        new = np.flatnonzero(keys[slot] != pair)
        if len(new):
            asked, back = np.unique(pair[new], return_inverse=True)
            told = self.compatible((asked >> 32).astype(np.int32), (asked & 0xFFFFFFFF).astype(np.int32))
            out[new] = told[back]
            keys[slot[new]], fits[slot[new]] = pair[new], out[new]
        return out

    def compatible(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether two tokens side by side stay two tokens.

        Their merges are replayed at the border only. Of the pair at the border, the left token's
        right edge grows when its next merge is due, the right token's left edge likewise; if the
        two edges themselves make a piece that is due first, they would have merged. Equal ranks
        are due from left to right.
        """
        out = np.ones(len(before), dtype=bool)
        live = np.flatnonzero((before != self.stray) & (after != self.stray))
        # the edges' way up: from the outermost letter of each token to the token itself
        edge_l, path_l = self._edges(before[live], self.right)
        edge_r, path_r = self._edges(after[live], self.left)
        at_l, at_r = edge_l.copy(), edge_r.copy()
        while len(live):
            rows = np.arange(len(live))
            x, y = path_l[rows, at_l], path_r[rows, at_r]
            grow_l = np.where(at_l > 0, self.rank[path_l[rows, np.maximum(at_l - 1, 0)]], _LATE)
            grow_r = np.where(at_r > 0, self.rank[path_r[rows, np.maximum(at_r - 1, 0)]], _LATE)
            slots = self.merges.find(x, y)
            found = self.merges.ranks[slots] != _LATE
            cross = np.where(found, self.rank[self.merges.products[slots]], _LATE)
            clash = found & (cross < grow_l) & (cross <= grow_r)
            out[live[clash]] = False
            done = clash | ((at_l == 0) & (at_r == 0))
            left_next = grow_l <= grow_r
            at_l = np.where(left_next & (at_l > 0), at_l - 1, at_l)
            at_r = np.where(~left_next & (at_r > 0), at_r - 1, at_r)
            stays = ~done
            live, at_l, at_r, path_l, path_r = live[stays], at_l[stays], at_r[stays], path_l[stays], path_r[stays]
        return out

    @staticmethod
    def _edges(tokens: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the column of its outermost letter, and the chain from the token down to it."""
        chain, depth = [tokens], np.zeros(len(tokens), dtype=np.int64)
        while True:
            down = child[chain[-1]]
            inner = down >= 0
            if not inner.any():
                return depth, np.stack(chain, axis=1)
            depth += inner
            chain.append(np.where(inner, down, chain[-1]))

    def last_tokens(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The last token of every prefix of every segment, at the prefix's last code point."""
        starts = np.cumsum(lengths) - lengths
        first = np.repeat(starts, lengths)
        place = np.arange(len(codes)) - first
        # automaton: step from all starts at once, as long as a piece may still follow
        at, state = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        room = np.repeat(lengths, lengths) - place
        begin, depth, found = at, 0, []
        while len(at):
            slots = self.steps.find(state, codes[at])
            ok = self.steps.ranks[slots] != _LATE
            begin, at, state = begin[ok], at[ok], self.steps.products[slots[ok]].astype(np.int64)
            piece = self.ends[state]
            whole = piece >= 0
            found.append((begin[whole], at[whole], piece[whole]))
            depth += 1
            more = room[begin] > depth
            begin, at, state = begin[more], at[more] + 1, state[more]
        begin, end, piece = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
        last = np.full(len(codes), -1, dtype=np.int32)
        symbol = self.letter[np.minimum(codes, len(self.letter) - 1)]
        lone = (symbol >= len(self.pieces))            # letters without a piece are tokens by themselves
        begin, end, piece = np.concatenate((begin, np.flatnonzero(lone))), np.concatenate((end, np.flatnonzero(lone))), np.concatenate((piece, symbol[lone]))
        order = np.argsort(place[end], kind="stable")
        begin, end, piece = begin[order], end[order], piece[order]
        cuts = np.searchsorted(place[end], np.arange(int(lengths.max()) + 1 if len(lengths) else 1))
        for a, b in zip(cuts, cuts[1:]):
            s, e, p = begin[a:b], end[a:b], piece[a:b]
            head = place[s] == 0
            last[e[head]] = p[head]
            s, e, p = s[~head], e[~head], p[~head]
            before = last[s - 1]
            fits = self.may_follow(before, p)
            last[e[fits]] = p[fits]
        return last

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """The symbols of each segment; ``stray`` and beyond-piece symbols stand for letters without a piece."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        last = self.last_tokens(codes, lengths)
        ends = np.cumsum(lengths)
        starts, at, which = ends - lengths, ends - 1, np.arange(len(segments))
        some = lengths > 0
        at, which = at[some], which[some]
        owner, token = [], []
        while len(at):
            t = last[at]
            owner.append(which)
            token.append(t)
            at = at - self.length[t]
            more = at >= starts[which]
            at, which = at[more], which[more]
        if not owner:
            return [[] for _ in segments]
        owner, token = np.concatenate(owner)[::-1], np.concatenate(token)[::-1]
        order = np.argsort(owner, kind="stable")
        flat, cuts = token[order].tolist(), np.searchsorted(owner[order], np.arange(len(segments) + 1)).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def segment_ids(self, segments: list[str]) -> list[list[int]]:
        """The ids of each segment: letters without a piece become their bytes, or unknown."""
        out = []
        for segment, symbols in zip(segments, self.encode_segments(segments)):
            if max(symbols, default=0) >= len(self.pieces):
                ids, at = [], 0
                for s in symbols:
                    width = int(self.length[s])
                    if s < len(self.pieces):
                        ids.append(s)
                    else:
                        raw = segment[at : at + width].encode("utf-8", "surrogatepass")
                        ids += [self.bytes[b] for b in raw] if self.bytes else [self.unknown]
                    at += width
                symbols = ids
            out.append(symbols)
        return out

    def decode_run(self, ids: list[int]) -> str:
        """The text of a run of ids, space marks as spaces; broken byte runs become U+FFFD."""
        if min(ids, default=self.byteless) >= self.byteless:
            return "".join([self.shown[i] for i in ids])
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.shown[i])
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of a whole encoding: without the space that encoding puts in front."""
        text = self.decode_run(ids)
        return text[1:] if text.startswith(" ") else text


class PieceCodec:
    """Encodes and decodes texts; remembers the segments it has met."""

    def __init__(self, vocabulary: PieceVocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, str] = {}          # segment key to its ids, joined by commas
        self.changed: dict[str, str] = {}        # texts of the few segments that decoding changes

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["vocabulary"])

    @staticmethod
    def segments(text: str) -> list[str]:
        """Keys of a text's segments: a word behind one space, or a line feed or a run of spaces with what follows."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if "\n" in marked:
            marked = marked.replace("\n", MARK + "\n")
        keys = marked.split(MARK)
        del keys[0]
        if "" not in keys:
            return keys
        out, run = [], 0                 # an empty key is a space with nothing behind it yet
        for key in keys:
            if key and not key.startswith("\n"):
                out.append(MARK * (run + 1) + key if run else key)
                run = 0
            elif key:
                out += [MARK * run, key] if run else [key]
                run = 0
            else:
                run += 1
        return out + [MARK * run] if run else out

    def learn(self, keys: list[str]) -> None:
        for start in range(0, len(keys), 20_000):
            own = keys[start : start + 20_000]
            segments = [k if k[0] in "\n" + MARK else MARK + k for k in own]
            for key, ids in zip(own, self.vocabulary.segment_ids(segments)):
                self.known[key] = ",".join(map(str, ids))
                decoded = self.vocabulary.decode_run(ids)
                if decoded != self._plain(key):
                    self.changed[key] = decoded

    @staticmethod
    def _plain(key: str) -> str:
        """The text of a segment that decoding gives back unchanged."""
        return key if key[0] == "\n" else key.replace(MARK, " ") if key[0] == MARK else " " + key

    def round_trip(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text its ids joined by commas, how many, and the text decoded from them."""
        cut = [self.segments(t) for t in texts]
        fresh = set().union(*cut).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, self.changed = {}, {}
            fresh = set().union(*cut)
        self.learn(list(fresh))
        out = []
        for keys in cut:
            ids = ",".join([self.known[k] for k in keys])
            if self.changed and not self.changed.keys().isdisjoint(keys):
                decoded = "".join([self.changed.get(k) or self._plain(k) for k in keys])
            else:
                decoded = "".join([self._plain(k) for k in keys])
            out.append((ids, ids.count(",") + bool(ids), decoded[1:]))
        return out


_CODED = T.StructType([T.StructField("ids", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])


def coded(text: Column, vocabulary: PieceVocabulary) -> Column:
    """A struct (ids, n_tokens, decoded) for a text; ids are decimal, joined by commas."""
    codec = PieceCodec(vocabulary)

    @F.arrow_udf(_CODED)
    def run(texts: pa.Array) -> pa.Array:
        ids, sizes, decoded = [], [], []
        for part in text_slices(texts):
            for i, n, d in codec.round_trip(part):
                ids.append(i), sizes.append(n), decoded.append(d)
        return pa.StructArray.from_arrays([pa.array(ids, pa.string()), pa.array(sizes, pa.int64()), pa.array(decoded, pa.string())], names=_CODED.names)

    return run(text)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(row, doc_id, ids, n_tokens, decoded) for every row of ``docs``, in one narrow pass.

    ``path`` is the model file, read on the driver. ``row`` is the document's own row; ``ids`` are
    decimal ids joined by commas, without begin or end; ``decoded`` is the text decoded from them.
    A missing or empty text has no ids and decodes to an empty text. No rows: no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return small_batches(docs).select(row, F.col("doc_id"), coded(whole_text(), PieceVocabulary(path)).alias("c")).select("row", "doc_id", "c.*")


def encode_stage(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, n_tokens and the ids as numbers: what a training run reads."""
    coded_docs = encode_documents(docs, path)
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", ",").cast("array<int>"))
    return coded_docs.select("doc_id", F.col("row.source").alias("source"), "n_tokens", ids.alias("ids"))
