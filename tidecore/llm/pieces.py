"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The best path over the pieces of a public vocabulary is found while the text streams by. Only states
within the longest piece of the current place can still matter; when the back pointers of all of them meet in
one boundary, the ids before it are final and are committed, and the window moves on. For a unigram model the
best path has the largest sum of scores. For a BPE model (``Merges``) the scores are ranks of merges and their sum says
nothing; there a path is right when every two neighbouring pieces stay apart if their characters are merged in the
order of the ranks, and exactly one right piece ends at each place. Pieces never reach over the
start of a word, so every word start is a boundary too; a word shorter than the window is read from its start, piece by
piece; words met before are looked up.

The project has no records of texts, so this operator is general.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidecore.llm.memory import lean

SPACE = "▁"
# Stands for a literal SPACE mark of the text, which must not be read as a space.
LITERAL = "\udc81"
# Words, and pairs of neighbouring pieces, remembered by a worker (older ones go first), and the longest words that are.
WORDS, PAIRS, WORD_CHARS = 400_000, 400_000, 48
UNKNOWN_PENALTY = 10.0


class Recent:
    """A lookup of bounded size: when the younger half is full, the older half goes."""

    def __init__(self, size: int):
        self.half = max(1, size // 2)
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Pieces:
    """A vocabulary: ids and scores of its pieces, byte pieces, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, tuple[int, float]] = {}
        self.bytes: list[int] = [-1] * 256
        self.decoded: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                self.decoded.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.decoded.append(b"")
            else:
                self.ids[piece] = (i, model.get_score(i))
                self.decoded.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.ids))
        self.unknown = min(s for _, s in self.ids.values()) - UNKNOWN_PENALTY
        crosses = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.words = re.compile(r"(?s).+" if crosses else rf"(?s){SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known = Recent(WORDS)

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in (SPACE if char == LITERAL else char).encode("utf-8", "surrogatepass")]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; an empty one has none."""
        if not text:
            return np.zeros(0, np.int32)
        marked = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)
        known, out = self.known, []
        for word in self.words.findall(marked):
            ids = known.young.get(word)
            if ids is None:
                ids = known.get(word)
                if ids is None:
                    ids = np.array(self.viterbi(word), np.int32).tobytes()
                    if len(word) <= WORD_CHARS:
                        known.put(word, ids)
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def viterbi(self, marked: str) -> list[int]:
        """Ids of the best path; states are kept only while a piece can still start at them."""
        best: dict[int, tuple[float, int, int]] = {0: (0.0, -1, -1)}  # place: score, previous place, id
        out: list[int] = []
        base = 0  # the last committed boundary
        for end in range(1, len(marked) + 1):
            best[end] = self.step(best, marked, max(base, end - self.longest), end)
            if end - base >= 2 * self.longest:
                cut = self._meeting(best, base, end)
                if cut > base:
                    self._commit(best, marked, base, cut, out)
                    for place in range(base, cut):
                        best.pop(place, None)
                    base = cut
        self._commit(best, marked, base, len(marked), out)
        return out

    def step(self, best: dict, marked: str, first: int, end: int) -> tuple[float, int, int]:
        """The best state at ``end``; among paths of the same score the one whose last piece is longest."""
        top = None
        for start in range(first, end):
            piece = self.ids.get(marked[start:end])
            if piece is not None:
                score, name = best[start][0] + piece[1], piece[0]
            elif start == end - 1:
                score, name = best[start][0] + self.unknown, -1
            else:
                continue
            if top is None or score > top[0]:
                top = (score, start, name)
        return top

    def _meeting(self, best: dict, base: int, end: int) -> int:
        """The latest boundary that the paths of all states still in reach run through."""
        live = sorted(range(max(base, end - self.longest + 1), end + 1))
        front = set(live)
        while len(front) > 1:
            last = max(front)
            front.discard(last)
            front.add(max(best[last][1], base))
        return front.pop()

    def _commit(self, best: dict, marked: str, base: int, cut: int, out: list[int]) -> None:
        path, at = [], cut
        while at > base:
            _, before, name = best[at]
            path.append((before, name))
            at = before
        for before, name in reversed(path):
            if name < 0:
                out += self.fallback(marked[before])
            else:
                out.append(name)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the inverse of ``encode``. An id that the vocabulary does not have is U+FFFD."""
        table = self.decoded
        if len(ids) and (ids.min() < 0 or ids.max() >= len(table)):
            text = b"".join([table[i] if 0 <= i < len(table) else b"\xef\xbf\xbd" for i in ids.tolist()])
        else:
            text = b"".join([table[i] for i in ids.tolist()])
        return text[1:].decode("utf-8", "replace") if text[:1] == b" " else text.decode("utf-8", "replace")


class Merges(Pieces):
    """A BPE vocabulary: the best-ranked merge comes first, the leftmost among equals.

    The pieces of a text are right if and only if every two neighbours are: merging the characters of the two
    gives back the two. So the last piece of each beginning of the text follows from the last pieces of shorter ones.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.names = {i: piece for piece, (i, _) in self.ids.items()}
        self.apart = Recent(PAIRS)
        # every end and every beginning of a piece, with the id where it is a piece itself
        self.tails: dict[str, int] = {p[k:]: -1 for p in self.ids for k in range(1, len(p))}
        self.tails.update((p, i) for p, (i, _) in self.ids.items())
        self.heads: dict[str, int] = {p[:k]: -1 for p in self.ids for k in range(1, len(p))}
        self.heads.update((p, i) for p, (i, _) in self.ids.items())
        # of each id: its characters, and the longest piece that it begins with (-1: none)
        self.sizes, self.shorter = [0] * len(self.decoded), [-1] * len(self.decoded)
        for p, (i, _) in self.ids.items():
            self.sizes[i] = len(p)
            self.shorter[i] = next((self.heads[p[:k]] for k in range(len(p) - 1, 0, -1) if self.heads[p[:k]] >= 0), -1)
        # whether every character of a piece is one itself, so that one without a piece parts a word
        self.spelled = all(c in self.ids for p in self.ids for c in p)

    def viterbi(self, marked: str) -> list[int]:
        if len(marked) >= 2 * self.longest or not self.spelled:
            return super().viterbi(marked)
        # A word that lies in the window whole is read from its start: the longest piece that is right beside the one before it,
        # a shorter one where that leads nowhere. The right pieces up to a place are the only ones, so a place is left for good.
        n, heads, sizes, shorter, young = len(marked), self.heads, self.sizes, self.shorter, self.apart.young
        out: list[int] = []
        places: list[int] = []
        left: set[int] = set()
        at, before, name = 0, -1, None
        while at < n:
            if name is None:  # a new place: its longest piece
                name, end = -1, at + 1
                longer = heads.get(marked[at])
                while longer is not None:
                    if longer >= 0:
                        name = longer
                    if end == n:
                        break
                    end += 1
                    longer = heads.get(marked[at:end])
                if name < 0:  # a character without a piece is in no piece either
                    out.append(-1)
                    places.append(at)
                    at, before, name = at + 1, -1, None
                    continue
            while name >= 0:
                end = at + sizes[name]
                if end not in left:
                    found = young.get((before, name))
                    if found or found is None and (before < 0 and end == at + 1 or self.stays(before, name)):
                        break
                name = shorter[name]
            if name >= 0:
                out.append(name)
                places.append(at)
                at, before, name = end, name, None
            else:
                left.add(at)
                at, name = places.pop(), shorter[out.pop()]
                before = out[-1] if out else -1
        if -1 not in out:
            return out
        return [i for name, at in zip(out, places, strict=True) for i in ([name] if name >= 0 else self.fallback(marked[at]))]

    def step(self, best: dict, marked: str, first: int, end: int) -> tuple[float, int, int]:
        """The one state at ``end`` whose last piece is right beside the one before it."""
        start, name = self.last(marked, end, first, [best[i][2] for i in range(first, end)], first)
        return 0.0, start, name

    def last(self, marked: str, end: int, first: int, names: list[int], base: int) -> tuple[int, int]:
        """Where the last piece of ``marked[:end]`` starts, and its id; ``names`` are the last ids at the places from ``base``."""
        tails, young = self.tails, self.apart.young
        for start in range(end - 1, first - 1, -1):
            name = tails.get(marked[start:end])
            if name is None:
                break
            if name >= 0:
                before = names[start - base]
                # one character after none or after an unknown one, which never merges, is right
                if before < 0 and start + 1 == end:
                    found = True
                else:
                    found = young.get((before, name))
                    if found is None:
                        found = self.stays(before, name)
                if found:
                    return start, name
        return end - 1, -1

    def stays(self, before: int, name: int) -> bool:
        """Whether two pieces (or a piece after none, -1) come out of merging their characters."""
        key = (before, name)
        found = self.apart.get(key)
        if found is None:
            pieces = [self.names[name]] if before < 0 else [self.names[before], self.names[name]]
            found = self.merged("".join(pieces)) == pieces
            self.apart.put(key, found)
        return found

    def merged(self, text: str) -> list[str]:
        """The pieces left when neighbours are merged in the order of the ranks; for a few characters."""
        parts = list(text)
        while True:
            top = None
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (top is None or piece[1] > top[0]):
                    top = (piece[1], i)
            if top is None:
                return parts
            i = top[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]


def _is_bpe(path: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model.trainer_spec.model_type == model.trainer_spec.BPE


@cache
def vocabulary(path: str) -> Pieces:
    return Merges(path) if _is_bpe(path) else Pieces(path)


def _fields(flow: DataFrame, made: list[T.StructField], carry: tuple[str, ...]) -> T.StructType:
    taken = {"u", *(f.name for f in made)} & set(carry)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made here and cannot be carried")
    return T.StructType([T.StructField("u", flow.schema["u"].dataType), *made, *(flow.schema[c] for c in carry)])


def encode_pieces(texts: DataFrame, path: str, carry: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """Ids of every text of ``(u, text)``: ``(u, ids)`` and the columns ``carry``, one row per row.

    ``path``: a SentencePiece model file that every executor can read. Whole texts
    are read. A null text has null ids, an empty one none; equal texts have equal ids;
    other columns are ignored. Characters without a piece become their bytes. With ``decoded`` the column
    ``decoded`` holds what the ids stand for, found in the same pass. An empty table gives an empty result.
    A word longer than ``WORD_CHARS`` is searched in a window and not remembered. ``carry`` must not name a column made here.
    """

    def run(batches):
        pieces = vocabulary(path)
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                texts_ = part["text"].to_pylist()
                ids = [pieces.encode(t or "") for t in texts_]
                none = pa.array([t is None for t in texts_])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)), mask=none)]
                if decoded:
                    made.append(pa.array([None if t is None else pieces.decode(x) for t, x in zip(texts_, ids, strict=True)], pa.string()))
                yield pa.record_batch([part["u"], *made, *(part[c] for c in carry)], names=["u", *(f.name for f in fields), *carry])

    flow = texts.select(*dict.fromkeys(["u", "text", *carry]))
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded
    return flow.mapInArrow(lean(run), _fields(flow, fields, carry))


def decode_pieces(ids: DataFrame, path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Texts of every row of ``(u, ids)``: ``(u, text)`` and the columns ``carry``.

    A null list stays null, an empty one is an empty text; an id that the vocabulary does not have, or a null one, is
    U+FFFD. An empty table gives an empty result. ``carry`` must not name a column made here.
    """

    def run(batches):
        pieces = vocabulary(path)
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                column = part["ids"]
                offsets, values = np.asarray(column.offsets), np.asarray(column.values.fill_null(-1))
                valid = column.is_valid().to_pylist()
                texts = [pieces.decode(values[a:b]) if v else None for a, b, v in zip(offsets[:-1], offsets[1:], valid, strict=True)]
                yield pa.record_batch([part["u"], pa.array(texts, pa.string()), *(part[c] for c in carry)], names=["u", "text", *carry])

    flow = ids.select(*dict.fromkeys(["u", "ids", *carry]))
    return flow.mapInArrow(lean(run), _fields(flow, [T.StructField("text", T.StringType())], carry))
