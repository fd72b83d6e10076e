"""N-best segmentations into the pieces of a SentencePiece vocabulary, and decoding.

Forward Viterbi scores give the best way to every place of the lattice.  They are exact
heuristics for an A-star search backwards from the end, which then finds the best segmentations
in order.  As no piece reaches over the start of a run of blanks, or over a line feed, the lattice
falls into chunks: each different chunk is scored once, and a text searches only chunks whose
second-best way is close enough to matter.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from binascii import crc32
from collections.abc import Iterator
from itertools import accumulate, count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import slices

BLANK = "▁"
BEST = 4
#: Score of a byte, where no piece covers a character, below the lowest piece.
BYTE_PENALTY = 10.0
NEVER = float("inf")
SEGMENTED = "n_pieces long, score double, ids_crc32 long, round_trip boolean, best array<struct<score:double,n_pieces:long,ids_crc32:long>>"


class Lattice:
    """Pieces of a model with their scores, and segmentations of chunks by them."""

    def __init__(self, path: str, most_chars: int = 8_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text_of: list[str | bytes] = []
        self.pieces: dict[str, tuple[float, bytes]] = {}
        self.byte_ids: dict[int, bytes] = {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = struct.pack("<I", i)
                byte = int(piece[3:-1], 16)
                self.text_of.append(chr(byte) if byte < 0x80 else bytes([byte]))
            elif model.is_control(i) or model.is_unknown(i):
                self.text_of.append("")
            else:
                self.pieces[piece] = model.get_score(i), struct.pack("<I", i)
                self.text_of.append(piece)
        # a tree of characters: a node has the piece that ends there, if any, and the nodes after it
        self.root: dict[str, list] = {}
        for piece, step in self.pieces.items():
            after = self.root
            for ch in piece:
                node = after.setdefault(ch, [None, {}])
                after = node[1]
            node[0] = step
        self.byte_score = min((s for s, _ in self.pieces.values() if s > -1e8), default=0.0) - BYTE_PENALTY
        self.pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        crossing = [p for p in self.pieces if BLANK in p.lstrip(BLANK) or "\n" in p]
        if crossing:
            raise ValueError(f"pieces reach over blanks or line feeds: {crossing[:3]}")
        self.whole_bytes = {i for i, x in enumerate(self.text_of) if isinstance(x, bytes)}
        self.known: dict[str, tuple[bytes, float, float]] = {}
        self.ways: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        self.chars, self.most = 0, most_chars

    def edges(self, chunk: str, i: int) -> Iterator[tuple[int, float, bytes]]:
        """Pieces that start at ``i``: where they end, their score, their ids; bytes where no piece has the character alone."""
        j, node = i + 1, self.root.get(chunk[i])
        if node is None or node[0] is None:
            raw = chunk[i].encode("utf-8", "surrogatepass")
            yield j, self.byte_score * len(raw), b"".join([self.byte_ids[b] for b in raw])
        while node is not None:
            if node[0] is not None:
                yield j, *node[0]
            if j == len(chunk):
                break
            node = node[1].get(chunk[j])
            j += 1

    def forward(self, chunk: str) -> tuple[list[float], list[tuple[int, bytes]], list[float]]:
        """For each place the best score, the last edge of the best way, and what the second-best last edge loses."""
        n = len(chunk)
        best, last, loss = [-NEVER] * (n + 1), [(0, b"")] * (n + 1), [NEVER] * (n + 1)
        best[0] = 0.0
        root = self.root.get
        for i in range(n):
            here, j = best[i], i + 1
            node = root(chunk[i])
            if node is None or node[0] is None:
                _, score, ids = next(self.edges(chunk, i))
                total, old = here + score, best[j]
                if total > old:
                    best[j], last[j], loss[j] = total, (i, ids), total - old
                elif old - total < loss[j]:
                    loss[j] = old - total
            while node is not None:
                step, after = node
                if step is not None:
                    total, old = here + step[0], best[j]
                    if total > old:
                        best[j] = total
                        last[j] = i, step[1]
                        loss[j] = total - old
                    elif old - total < loss[j]:
                        loss[j] = old - total
                if j == n:
                    break
                node = after.get(chunk[j])
                j += 1
        return best, last, loss

    def apart(self, chunk: str) -> list[str]:
        """A chunk cut where no piece holds the two characters beside the cut, so no piece reaches over it."""
        pairs, out, last = self.pairs, [], 0
        for k in range(1, len(chunk)):
            if chunk[k - 1 : k + 1] not in pairs:
                out.append(chunk[last:k])
                last = k
        out.append(chunk[last:])
        return out

    def scored(self, part: str) -> tuple[bytes, float, float]:
        """Ids of the best way, its score, and what the second-best way loses."""
        best, last, loss = self.forward(part)
        ids, second, j = [], NEVER, len(part)
        while j:
            if loss[j] < second:
                second = loss[j]
            j, more = last[j]
            ids.append(more)
        return b"".join(ids[::-1]), best[-1], second

    def chunk(self, chunk: str) -> tuple[bytes, float, float]:
        """The same of a chunk, remembered, as are its parts."""
        if self.chars > self.most:
            self.known.clear()
            self.ways.clear()
            self.chars = 0
        found = []
        for part in self.apart(chunk):
            one = self.known.get(part)
            if one is None:
                one = self.known[part] = self.scored(part)
                self.chars += len(part)
            found.append(one)
        if len(found) > 1:
            whole = b"".join([f[0] for f in found]), sum([f[1] for f in found]), min([f[2] for f in found])
            self.chars += len(chunk)
        else:
            whole = found[0]
        self.known[chunk] = whole
        return whole

    def ways_of(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """``n_best``, remembered: the same few chunks are nearly tied again and again."""
        found = self.ways.get((chunk, n))
        if found is None:
            found = self.n_best(chunk, n)
            # the way that the forward pass took is the first of its equals
            first = self.scored(chunk)[0]
            found = [(found[0][0], first), *[w for w in found if w[1] != first]][:n]
            if len(chunk) <= 64:
                self.ways[chunk, n] = found
                self.chars += n * len(chunk)
        return found

    def n_best(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """The ``n`` best ways, best first: score and ids.  Backward A-star with the forward scores.

        No way among the ``n`` best goes on from a place by any but its ``n`` best rests, which are
        the first ``n`` to reach it, so a place is left ``n`` times at most.  Among equal totals the
        last found, which is the furthest, goes first.  Long runs of one character, with their many
        equal ways, thus cost in proportion to their length.
        """
        best = self.forward(chunk)[0]
        arriving: list[list[tuple[int, float, bytes]]] = [[] for _ in range(len(chunk) + 1)]
        for i in range(len(chunk)):
            for j, score, ids in self.edges(chunk, i):
                arriving[j].append((i, score, ids))
        order, out, reached = count(0, -1), [], [0] * len(arriving)
        agenda = [(-best[-1], next(order), len(chunk), 0.0, None)]
        while agenda and len(out) < n:
            _, _, j, behind, way = heapq.heappop(agenda)
            if reached[j] == n:
                continue
            reached[j] += 1
            if not j:
                ids = []
                while way:
                    ids.append(way[0])
                    way = way[1]
                out.append((behind, b"".join(ids)))
                continue
            for i, score, ids in arriving[j]:
                heapq.heappush(agenda, (-(best[i] + score + behind), next(order), i, score + behind, (ids, way)))
        return out

    def segment(self, text: str, n: int = BEST) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations of a whole text, best first: score and ids."""
        if not text:
            return [(0.0, b"")]
        chunks = CHUNK.findall(BLANK + text.replace(" ", BLANK))
        known = self.known.get
        found = [known(c) or self.chunk(c) for c in chunks]
        ids = [f[0] for f in found]
        total = sum([f[1] for f in found])
        whole = b"".join(ids)
        if n < 2:
            return [(total, whole)]
        losses = [f[2] for f in found]
        most = heapq.nsmallest(n - 1, losses)[-1]
        near = [k for k, x in enumerate(losses) if x <= most < NEVER or x < most]
        near = sorted(near, key=losses.__getitem__)[: n - 1]
        ways = [self.ways_of(chunks[k], n) for k in near]
        # choices of ways in the near chunks, in order of what they lose together
        agenda, seen, out = [(0.0, (0,) * len(near))], set(), []
        starts = [0, *accumulate(map(len, ids))]
        while agenda and len(out) < n:
            loss, choice = heapq.heappop(agenda)
            parts, last = [], 0
            for x in sorted(range(len(near)), key=near.__getitem__):
                if choice[x]:
                    k = near[x]
                    parts += [whole[last : starts[k]], ways[x][choice[x]][1]]
                    last = starts[k] + len(ids[k])
            out.append((total - loss, b"".join([*parts, whole[last:]])))
            for x in range(len(near)):
                if choice[x] + 1 < len(ways[x]):
                    after = (*choice[:x], choice[x] + 1, *choice[x + 1 :])
                    if after not in seen:
                        seen.add(after)
                        more = ways[x][choice[x]][0] - ways[x][choice[x] + 1][0]
                        heapq.heappush(agenda, (loss + more, after))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces and bytes joined, blanks for ``BLANK``, less the blank in front."""
        numbers = array("I", ids)
        parts = map(self.text_of.__getitem__, numbers)
        if self.whole_bytes.isdisjoint(numbers):
            joined = "".join(parts)
        else:
            joined = b"".join([p if isinstance(p, bytes) else p.encode("utf-8", "surrogatepass") for p in parts]).decode("utf-8", "surrogatepass")
        return joined.replace(BLANK, " ")[1:]


CHUNK = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")


def segmented(docs: DataFrame, model_path: str, n: int = BEST) -> DataFrame:
    """``docs`` without ``text``, with the best segmentation's figures and the ``n`` best (columns of ``SEGMENTED``).

    A null or empty text has no pieces and one segmentation, score 0.  ``round_trip`` tells
    whether the best ids decode to the text, which fails only where it holds U+2581 itself.
    Segmentations of equal score may come in either order.  Columns of these names are replaced,
    all others stay.
    """
    names = [c.split()[0] for c in SEGMENTED.split(", ")[:4]] + ["best"]
    kept = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model_path)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64())]))
        kinds = [pa.int64(), pa.float64(), pa.int64(), pa.bool_(), kind]
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                found = lattice.segment(text or "", n)
                best = [{"score": s, "n_pieces": len(ids) // 4, "ids_crc32": crc32(ids)} for s, ids in found]
                rows.append((best[0]["n_pieces"], best[0]["score"], best[0]["ids_crc32"], lattice.decode(found[0][1]) == (text or ""), best))
            out = [c for c, name in zip(batch.columns, batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*out, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [*(x for x in batch.schema.names if x != "text"), *names])

    fields = [f for f in kept.schema.fields if f.name != "text"]
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), SEGMENTED]))
