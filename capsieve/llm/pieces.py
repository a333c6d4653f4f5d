"""Exact merge-type encoding by backtracking, and decoding, for SentencePiece models of the merge type.

A sequence of vocabulary pieces is what merging gives exactly when each piece survives merging on its own and each
adjacent pair does so together. So the encoder walks the text with the longest match at each position (found by an
Aho-Corasick automaton), checks the new piece against the one before by merging the two once more, takes shorter
prefixes where they clash, and steps back where nothing fits; a bit field of failed positions keeps it from trying
any position twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsieve.llm.tables import kept_in_worker, packed

#: The mark that stands for a space inside pieces, and the piece types of the file format.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct units whose ids a worker remembers: the newest up to this number and as many before. Longer ones aren't.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 48


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """Pieces (text, score, type) in the order of their ids, and whether a space is put before the text."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules, trained = model.normalizer_spec, model.trainer_spec
    if trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
        raise ValueError("only merge-type models with byte fallback are supported")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("only models that keep the text as it is are supported")
    if any(p.type in (USER_DEFINED, UNUSED) for p in model.pieces):
        raise ValueError("models with user-defined or unused pieces are not supported")
    return [(p.piece, p.score, p.type) for p in model.pieces], rules.add_dummy_prefix


class Codec:
    """Encoder and decoder of one model; built once in a worker."""

    def __init__(self, pieces: list[tuple[str, float, int]], dummy_prefix: bool):
        import ahocorasick

        self.dummy_prefix = dummy_prefix
        self.pieces = pieces
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.end = [str(i) for i, (p, _, kind) in enumerate(pieces) if kind == CONTROL and p == "</s>"]
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unit = re.compile(f"{SPACE}*[^{SPACE}]*")
        if any(SPACE in p.lstrip(SPACE) for p in self.score):  # then no border of words stops a merge
            self.unit = re.compile(r"(?s).+")
        runs = {p for p in self.score if len(p) > 1 and not p.strip(SPACE)}
        scores = [s for p, s in self.score.items() if len(p) > 1 and p not in runs]
        in_runs = {self.score[p] for p in runs}
        if len(set(scores)) < len(scores) or len(in_runs) > 1 or max(in_runs, default=-1e30) >= min(scores):
            raise ValueError("pieces share scores; their merges have no single order")
        #: Character pairs inside pieces: no merge crosses a border between two others.
        self.joined = {a + b for p in self.score for a, b in zip(p, p[1:])}
        self.reach = {p for p in self.score if p not in runs and self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.reach:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reach), None) for p in self.reach}
        self.fits: dict[tuple[str, str], bool] = {}
        text_of = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: " ⁇ ".encode()}
        #: Bytes of each id, by its decimal text.
        self.raw = {str(i): text_of[kind](p) if kind in text_of else b"" for i, (p, _, kind) in enumerate(pieces)}
        self.parts: dict[str, str] = {}
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: Units whose ids decode to other text than the unit's own, with that text; kept with ``known``.
        self.odd: dict[str, str] = {}

    def merge(self, text: str) -> list[str]:
        """Merging as defined: the pair of the best score first, of equal ones the leftmost. For short texts."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score), default=None)
            if best is None:
                break
            parts[-best[1] : 2 - best[1]] = [parts[-best[1]] + parts[1 - best[1]]]
        return parts

    def fit(self, a: str, b: str) -> bool:
        """Whether two adjacent pieces stay as they are when their text is merged again."""
        if a[-1] + b[0] not in self.joined:
            return True
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self.merge(a + b) == [a, b]
        return known

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text without runs of spaces; characters without a piece stand alone."""
        n = len(text)
        longest = list(text)
        for end, piece in self.automaton.iter(text):
            longest[end + 1 - len(piece)] = piece  # later ends are longer
        failed = bytearray(n + 1)
        out: list[str] = []
        at, piece = 0, longest[0]
        while at < n:
            while piece is not None and (failed[at + len(piece)] or (out and not self.fit(out[-1], piece))):
                piece = self.shorter.get(piece)
            if piece is None:
                failed[at] = 1
                piece = out.pop()
                at -= len(piece)
            else:
                out.append(piece)
                at += len(piece)
                piece = longest[at] if at < n else None
        return out

    def spelt(self, text: str) -> str:
        """Ids of a text without runs of spaces, as decimal text; remembered for short ones."""
        found = self.parts.get(text)
        if found is None:
            found = str(self.id[text]) if text in self.reach else self.spell(self.backtrack(text))
            if len(text) <= LONGEST_REMEMBERED:
                if len(self.parts) >= REMEMBERED // 2:
                    self.parts.clear()
                self.parts[text] = found
        return found

    def cut(self, text: str) -> list[str]:
        """Parts between which no merge is possible."""
        joined = self.joined
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joined]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if cuts else [text]

    def split(self, unit: str) -> list[str]:
        """Pieces of a unit: spaces, then other characters."""
        word = unit.lstrip(SPACE)
        spaces = len(unit) - len(word)
        out = [p for part in self.cut(SPACE * min(1, spaces) + word) for p in self.backtrack(part)]
        if spaces > 1:  # merges of spaces come last, from the left
            left = spaces - (out[0] != SPACE)
            out = self.run(left) + out[out[0] == SPACE :]
        return out

    def run(self, length: int) -> list[str]:
        """Merges inside a run of spaces have one score, so the leftmost possible one is always the next."""
        out: list[int] = []
        for _ in range(length):
            out.append(1)
            while len(out) > 1 and SPACE * (out[-2] + out[-1]) in self.score:
                out[-2:] = [out[-2] + out[-1]]
        return [SPACE * k for k in out]

    def spell(self, pieces: Iterable[str]) -> str:
        """Decimal ids joined by a space; a character without a piece becomes its bytes."""
        out: list[str] = []
        for p in pieces:
            i = self.id.get(p)
            out += [str(self.byte_id[b]) for b in p.encode()] if i is None else [str(i)]
        return " ".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: bytes join to characters (bad ones give U+FFFD), marks become spaces, the first one goes."""
        out, raw, first = [], bytearray(), self.dummy_prefix
        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                raw.append(int(piece[3:5], 16))
                first = False
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw = bytearray()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
                first = False
            elif kind != CONTROL:
                if first and piece[0] == SPACE:
                    piece = piece[1:]
                first = False
                out.append(piece.replace(SPACE, " "))
        return "".join(out) + raw.decode(errors="replace")

    def decode_spelt(self, ids: str) -> str:
        """The same from decimal ids, all pieces' bytes joined at once; the long way where they aren't valid."""
        try:
            text = b"".join(map(self.raw.__getitem__, ids.split(" "))).decode() if ids else ""
        except UnicodeDecodeError:
            return self.decode(map(int, ids.split(" ")))
        first = next((p for p in map(int, ids.split(" ", 2)[:2]) if self.pieces[p][2] != CONTROL), None) if ids else None
        return text[1:] if self.dummy_prefix and first is not None and self.pieces[first][0][0] == SPACE else text

    def text_of(self, ids: str) -> str:
        """What ids decode to, the first mark included."""
        raw = b"".join(map(self.raw.__getitem__, ids.split(" "))) if ids else b""
        return raw.decode(errors="replace")

    def entry(self, unit: str) -> str:
        """Ids of a unit that isn't among the newest remembered ones; they are decoded, and what isn't the unit is noted."""
        found = self.older.get(unit)
        if found is None:
            found = self.spell(self.split(unit)) if SPACE * 2 in unit else " ".join(map(self.spelt, self.cut(unit)))
        said = self.text_of(found)
        if said != unit.replace(SPACE, " "):
            self.odd[unit] = said
        if len(unit) <= LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[unit] = found
        return found

    def encode(self, text: str, end: bool = True) -> tuple[int, str, str]:
        """Number of ids, ids as decimal text joined by a space, and the text that they decode to.

        No piece crosses the border of two units, so the decoded text is that of the units' ids one after the other.
        """
        marked = (SPACE * self.dummy_prefix + text).replace(" ", SPACE) if text else ""
        known, entry = self.known, self.entry
        units = [u for u in self.unit.findall(marked) if u]
        found = [known.get(u) or entry(u) for u in units]
        ids = " ".join(found + self.end if end else found)
        if self.odd and any(u in self.odd for u in units):
            decoded = self.decode_spelt(ids)
        else:
            decoded = marked.replace(SPACE, " ")
            if self.dummy_prefix and units and self.pieces[int(found[0].partition(" ")[0])][0][0] == SPACE:
                decoded = decoded[1:]
        return ids.count(" ") + 1 if ids else 0, ids, decoded


def codec(key: str, pieces: list[tuple[str, float, int]], dummy_prefix: bool) -> Codec:
    """The codec of a model, kept while a worker lives."""
    return kept_in_worker("capsieve_codec", key, lambda: Codec(pieces, dummy_prefix))


def encode(docs: DataFrame, model: str, text: str = "text", end: bool = True, decoded: bool = True) -> DataFrame:
    """Rows of ``docs`` with ``n_tokens``, ``ids`` (decimal, joined by a space) and ``decoded`` (the ids' text again).

    ``model`` is a path on the driver; its pieces, some hundred kilobytes, go to the workers. Null counts as empty,
    which has the end id only. Texts of any length are encoded whole. Repeated rows give repeated results, an empty
    table none; columns with the names made here are replaced.
    """
    pieces, dummy_prefix = read_model(model)
    key = hashlib.sha256(repr((pieces, dummy_prefix)).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((key, pieces, dummy_prefix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(*shared.value)
        for batch in batches:
            found = [own.encode(t or "", end) for t in batch["text"]]
            out = pd.DataFrame(found, columns=["n_tokens", "ids", "decoded"], dtype=object)
            yield pd.concat([batch[["row"]], out if decoded else out.drop(columns="decoded")], axis=1)

    made = ["n_tokens", "ids", "decoded"][: 2 + decoded]
    rows = docs.select(packed(docs, *made).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.StringType()) for c in made[1:]]])
    return rows.mapInPandas(run, schema).select("row.*", *made)
