"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

For BPE the last token of the encoding of every prefix is unique.  A forward
pass over an Aho-Corasick automaton lists the pieces that end at each
position; the one that is compatible with the last token of the prefix before
it (no merge across the border would have won) is stored, and the ids are
recovered backwards from the end of the text.

Pieces never join a character with a following space mark, nor do they hold a
line feed, so a text is cut before every such mark and the parts are encoded
on their own; each Python worker keeps the last parts in a bounded table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
_UNKNOWN = -1


class PieceModel:
    """Tables of a BPE model: built once on the driver, sent to the workers (their size is that of the vocabulary)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.end_id = sp.eos_id()
        piece = {i: sp.id_to_piece(i) for i in plain}
        self.text = {i: p.replace(MARK, " ") for i, p in piece.items()}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        # Runs of the space mark share one score, the lowest of all: they merge last and leftmost first.
        self.runs = {len(p): i for i, p in piece.items() if set(p) == {MARK}}
        merges = sorted((i for i in plain if len(piece[i]) > 1 and set(piece[i]) != {MARK}), key=lambda i: -sp.get_score(i))
        scores = [sp.get_score(i) for i in merges]
        if len(set(scores)) != len(scores) or any("\n" in piece[i] or MARK in piece[i][1:] for i in merges) or len(self.byte_ids) != 256:
            raise ValueError("a model with equal scores, pieces across spaces or lines, or without byte pieces isn't supported")
        if (low := [sp.get_score(i) for n, i in self.runs.items() if n > 1]) and scores and (len(set(low)) > 1 or low[0] >= scores[-1]):
            raise ValueError("runs of spaces must share the lowest score")
        base = [i for i in plain if len(piece[i]) == 1]
        self.ids = base + merges  # by merge order; single characters first
        self.strings = [piece[i] for i in self.ids]
        self.n_base = len(base)
        rank = {p: r for r, p in enumerate(self.strings)}
        self.split: list[tuple[int, int]] = [(r, r) for r in range(self.n_base)]
        self.pairs: dict[tuple[int, int], int] = {}
        self.reachable = [True] * len(self.strings)
        for r in range(self.n_base, len(self.strings)):
            parts = self._merge(self.strings[r], rank, r)
            if len(parts) == 2 and max(parts) < r:
                self.split.append((parts[0], parts[1]))
                self.pairs[parts[0], parts[1]] = r
            else:
                self.split.append((r, r))
                self.reachable[r] = False

    @staticmethod
    def _merge(text: str, rank: dict[str, int], below: int) -> list[int]:
        """Plain BPE of a piece with the merges before it."""
        parts = [rank.get(c, _UNKNOWN) for c in text]
        strings = list(text)
        while len(parts) > 2:
            found = [(rank.get(strings[k] + strings[k + 1], below), k) for k in range(len(parts) - 1)]
            best, k = min(found)
            if best >= below:
                break
            parts[k : k + 2] = [best]
            strings[k : k + 2] = [strings[k] + strings[k + 1]]
        return parts


class Encoder:
    """Encodes parts of texts; one for each Python worker."""

    def __init__(self, model: PieceModel, keep: int = 180_000):
        import ahocorasick

        self.m = model
        self.automaton = ahocorasick.Automaton()
        for r, p in enumerate(model.strings):
            if model.reachable[r] and p != MARK:
                self.automaton.add_word(p, (len(p), r))
        self.automaton.make_automaton()
        self.mark = next((r for r in range(model.n_base) if model.strings[r] == MARK), _UNKNOWN)
        self.fits: list[dict[int, bool]] = [{} for _ in model.strings]
        self.known = 0
        # What a token comes to, as a decimal id and as text.
        self.id_text = [str(i) for i in model.ids]
        self.rank_text = [model.text[i] for i in model.ids]
        self.keep = keep
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def forget(self) -> None:
        """Give back what texts have left, as an executor keeps its workers from stage to stage."""
        self.young, self.old, self.known = {}, {}, 0
        self.fits = [{} for _ in self.fits]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE, having made *a* and *b* side by side, keeps the border between them."""
        pairs, split, limit, ok = self.m.pairs, self.m.split, len(self.m.strings), True
        x, y = a, b
        while True:
            if pairs.get((x, y), limit) < limit:
                ok = False
                break
            if x > y:
                limit, x = x, split[x][1]
                if x != limit:
                    continue
                limit, y = y + 1, split[y][0]
                if y + 1 == limit:
                    break
            else:
                limit, y = y + 1, split[y][0]
                if y + 1 != limit:
                    continue
                limit, x = x, split[x][1]
                if x == limit:
                    break
        if self.known >= 400_000:
            self.known = 0
            for found in self.fits:
                found.clear()
        self.known += 1
        self.fits[a][b] = ok
        return ok

    def tokens(self, text: str) -> list[int]:
        """Ranks of the tokens of a text; below 0: minus 1 minus the code point of a character outside the vocabulary."""
        n = len(text)
        last: list[int] = [-1] * (n + 1)
        size: list[int] = [1] * (n + 1)
        done = 0  # the positions up to this one have their token
        fits = self.fits

        def single(k: int) -> None:
            last[k] = self.mark if text[k - 1] == MARK and self.mark >= 0 else -1 - ord(text[k - 1])

        for at, (length, r) in self.automaton.iter(text):
            if at < done:
                continue
            if at > done:  # positions where no piece fitted
                for k in range(done + 1, at + 1):
                    single(k)
                done = at
            at += 1
            before = last[at - length]
            if before >= 0 and at > length:
                ok = fits[before].get(r)
                if ok is None:
                    ok = self.compatible(before, r)
                if not ok:
                    continue
            last[at], size[at], done = r, length, at
        for k in range(done + 1, n + 1):
            single(k)
        out = []
        k = n
        while k:
            out.append(last[k])
            k -= size[k]
        return out[::-1]

    def merged_runs(self, count: int) -> list[int]:
        """Ids of a run of space marks: leftmost pair first, as long as the joined run is a piece."""
        runs, sizes, k = self.m.runs, [1] * count, 0
        if count > 64:  # full pieces come off the front, each on its own
            sizes = [16] * ((count - 32) // 16) + [1] * (count - (count - 32) // 16 * 16) if 16 in runs and 17 not in runs else sizes
        left: list[int] = []
        right = sizes[::-1]
        while right:
            x = right.pop()
            if left and left[-1] + x in runs:
                right.append(left.pop() + x)
            elif right and x + right[-1] in runs:
                right.append(x + right.pop())
            else:
                left.append(x)
            k += 1
        return [i for s in left for i in ([runs[s]] if s in runs else self.characters(MARK))]

    def characters(self, c: str) -> list[int]:
        return [self.m.byte_ids[b] for b in c.encode()]

    def ids(self, text: str) -> list[int]:
        """Ids of a part in which spaces are marks."""
        return self.joined(self.tokens(text))

    def joined(self, ranks: list[int]) -> list[int]:
        """Ids of tokens: runs of space marks are merged, characters outside the vocabulary are bytes."""
        out: list[int] = []
        run = 0
        for r in ranks:
            if r == self.mark or r == -1 - ord(MARK):
                run += 1
                continue
            if run:
                out += self.merged_runs(run)
                run = 0
            if r >= 0:
                out.append(self.m.ids[r])
            else:
                out += self.characters(chr(-1 - r))
        return out + self.merged_runs(run) if run else out

    def decode(self, ids: list[int]) -> str:
        """Text of ids, with the leading space that encoding adds; byte pieces in a row are one UTF-8 sequence."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if (b := self.m.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if (s := self.m.text.get(i)) is not None:
                out.append(s)
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def part(self, key: str) -> tuple[str, str]:
        """Ids, as decimals, and their text, of a part: as many spaces as the key has and one more, then a word; or a line feed and a word."""
        got = self.old.get(key)
        if got is None:
            got = self._part(key)
        if len(self.young) >= self.keep:
            self.old, self.young = self.young, {}
        self.young[key] = got
        return got

    def _part(self, key: str) -> tuple[str, str]:
        if key[:1] == "\n":
            ids = self.characters("\n") + self.ids(key[1:])
        else:
            ranks = self.tokens(MARK + key.replace(" ", MARK))
            if min(ranks) >= 0 and self.mark not in ranks:  # pieces alone, no byte and no run of spaces
                return " ".join([self.id_text[r] for r in ranks]), "".join([self.rank_text[r] for r in ranks])
            ids = self.joined(ranks)
        return " ".join(map(str, ids)), self.decode(ids)

    def parts(self, text: str) -> list[str]:
        """The keys of a text's parts, in order."""
        if not text:
            return []
        found = text.replace(MARK, " ").replace("\n", " \n").split(" ")
        if "" not in found:
            return found
        out, run = [], 0
        for p in found:
            if not p:
                run += 1
            elif p[0] == "\n":
                if run:
                    out.append(" " * (run - 1))
                out.append(p)
                run = 0
            else:
                out.append(" " * run + p)
                run = 0
        if run:
            out.append(" " * (run - 1))
        return out

    def encode(self, text: str) -> tuple[str, str]:
        """Ids of a text with the end id, as decimals joined by a space, and the text decoded from them."""
        keys = self.parts(text)
        young = self.young
        found = []
        for key in keys:
            got = young.get(key)
            if got is None:
                got = self.part(key)
                young = self.young
            found.append(got)
        end = str(self.m.end_id)
        text = "".join([x[1] for x in found])
        return " ".join([x[0] for x in found] + [end]), text[1:] if text[:1] == " " else text


_encoders: dict[str, Encoder] = {}


def encode(docs: DataFrame, model_path: str, text: str = "text", digest: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Encode a text column exactly as the sentencepiece library does, with an end id, and decode the ids.

    Returns the *carry* columns (default: all columns of *docs* but the text), ``n_tokens``, and either
    ``ids array<int>`` and ``decoded string`` or, with *digest*, ``ids_sha256`` and ``decoded_sha256``.
    Null and empty texts give the end id alone and an empty decoded text.  Repeated rows give repeated
    rows; an empty table gives an empty table; extra columns that are named like the results are replaced.
    One map over the table, no shuffle.
    """
    names = ["n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])]
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in (text, *names)]
    source = docs.select(*[f"`{c}`" for c in carry], docs[text].cast("string").alias("__text"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(PieceModel(model_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _encoders:
            _encoders.clear()
            _encoders[model_path] = Encoder(shared.value)
        encoder = _encoders[model_path]
        for batch in batches:
            count, ids, decoded = [], [], []
            for i, value in enumerate(batch.column(len(carry))):
                a, b = encoder.encode(value.as_py() or "")
                count.append(a.count(" ") + 1)
                if digest:
                    ids.append(hashlib.sha256(a.encode()).hexdigest())
                    decoded.append(hashlib.sha256(b.encode()).hexdigest())
                else:
                    ids.append([int(x) for x in a.split(" ")])
                    decoded.append(b)
                if not digest and (i % 256 == 255):  # long lists leave as they come
                    lo = i - len(count) + 1
                    yield _batch(batch, carry, names, lo, count, ids, decoded, digest)
                    count, ids, decoded = [], [], []
            if count:
                yield _batch(batch, carry, names, batch.num_rows - len(count), count, ids, decoded, digest)
        encoder.forget()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    kinds = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens bigint, ids array<int>, decoded string"
    return source.mapInArrow(work, f"{kept}, {kinds}" if kept else kinds)


def _batch(batch, carry, names, lo, count, ids, decoded, digest) -> pa.RecordBatch:
    kept = [batch.column(k).slice(lo, len(count)) for k in range(len(carry))]
    kind = pa.string() if digest else pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([*kept, pa.array(count, pa.int64()), pa.array(ids, kind), pa.array(decoded, pa.string())], [*carry, *names])
