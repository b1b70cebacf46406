"""Byte-level BPE with the ``tokenizers`` library, over Arrow batches.

Byte-level BPE maps each UTF-8 byte to a printable character, splits the text
by a pattern and merges inside each split only.  So the ids of a split do not
depend on its neighbours, and a worker asks the library once for each distinct
split it meets: the splits of a block that are new go to the library in one
call, and the answers stay in a table of bounded size.  Splits are found and
looked up for whole blocks of texts (``splits``), without a Python object per
split or token.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np

from cellmill.llm.splits import INLINE, SPACE, Table, found_splits, keys, safe_cuts, spread, usual_splits

#: Entries of a worker's table of known splits; beyond it those that were met once are forgotten.
KNOWN = 600_000
#: Characters of a block of texts.
BLOCK = 1 << 20
#: The pattern whose splits are found without a regular expression.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def split_pattern(pattern: str) -> str:
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s+(?!\S)", f"[{SPACE}]+(?![^{SPACE}])").replace(r"|\s+", f"|[{SPACE}]+")


def byte_characters() -> list[str]:
    """The printable character of each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge list behind a rank table: each token's last two parts under the merges of lower rank."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    """Encodes by a ``tokenizers`` JSON file or a ``tiktoken`` rank file.

    added: tokens that the file adds to its vocabulary are found in texts before these are split, as the library does by
    default; without it, their strings are ordinary text.
    """

    def __init__(self, path: str, pattern: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        chars = byte_characters()
        extra: dict[str, int] = {}
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                file = json.load(f)
            model = file["model"]
            vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            for token in file.get("added_tokens") or ():
                if added and any(token.get(k) for k in ("single_word", "lstrip", "rstrip")):
                    raise ValueError(f"added token {token['content']!r} takes its surroundings into account")
                extra[token["content"]] = token["id"]
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            mapped = lambda token: "".join(chars[b] for b in token)
            vocab, merges = {mapped(t): r for t, r in ranks.items()}, [(mapped(a), mapped(b)) for a, b in merges_of(ranks)]
        # mapped splits hold no white space, so spaces can part them
        self.ask = Tokenizer(models.BPE(vocab=vocab, merges=merges, cache_capacity=0))
        self.ask.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        back = {c: b for b, c in enumerate(chars)}
        self.size = max([*vocab.values(), *extra.values()]) + 1
        table: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            if all(c in back for c in token):
                table[i] = bytes(back[c] for c in token)
        for token, i in extra.items():
            table[i] = token.encode()
        self.widths = np.array([len(t) for t in table], np.int64)
        self.bytes, self.begins = np.frombuffer(b"".join(table), np.uint8), np.cumsum(self.widths) - self.widths
        self.chars = np.array([ord(c) for c in chars], "<u4")
        self.find = None if pattern == USUAL else regex.compile(split_pattern(pattern)).findall
        self.extra = extra if added else {}
        self.extra_any = re.compile("(" + "|".join(map(re.escape, sorted(self.extra, key=len, reverse=True))) + ")") if self.extra else None
        self.known, self.long = Table(), {}

    def _learn(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Asks the library for the ids of these stretches: (all ids, end of each stretch's)."""
        mapped = self.chars[raw[spread(begin, size)]]
        ends = np.cumsum(size)
        parted = np.insert(mapped, ends, 0x20).tobytes()
        cuts = [0, *(4 * (ends + np.arange(1, len(ends) + 1)))[999::1000].tolist(), len(parted)]
        asked = [parted[a:b].decode("utf-32-le") for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.ask.encode_batch_fast(asked, add_special_tokens=False)])
        # where a stretch's bytes end, a token ends
        return ids, np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1

    def _slots(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The place in the table of known splits of each short split."""
        if self.known.n > KNOWN:
            self.known.forget()
        self.known.room(len(begin))
        k = keys(raw, begin, size)
        slot = self.known.find(k)
        self.known.met[slot[slot >= 0]] = True
        new = np.flatnonzero(slot < 0)
        if len(new):
            order = new[np.lexsort((k[new, 0], k[new, 1]))]
            first = np.concatenate([[True], (k[order[1:]] != k[order[:-1]]).any(1)])
            one = order[first]
            which = self.known.put(k[one], *self._learn(raw, begin[one], size[one]))
            slot[order] = which[np.cumsum(first) - 1]
        return slot

    def _long(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The ids of each longer split."""
        names = [raw[a : a + n].tobytes() for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
        if len(self.long) > KNOWN // 10 or sum(map(len, self.long)) > BLOCK:
            self.long = {}
        new = {x: i for i, x in enumerate(names) if x not in self.long}
        if new:
            at = np.array(list(new.values()))
            ids, ends = self._learn(raw, begin[at], size[at])
            self.long.update(zip(new, np.split(ids, ends[:-1]), strict=True))
        return [self.long[x] for x in names]

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        raw, begin, edges = found_splits(texts, self.find) if self.find else usual_splits(texts)
        size = np.diff(begin, append=len(raw))
        padded = np.frombuffer(raw + bytes(INLINE + 1), np.uint8)
        short = size <= INLINE
        if short.all():
            ids, count = self.known.gather(self._slots(padded, begin, size))
        else:
            longer = self._long(padded, begin[~short], size[~short])
            own, n = self.known.gather(self._slots(padded, begin[short], size[short]))
            count = np.empty(len(size), np.int64)
            count[short], count[~short] = n, [len(x) for x in longer]
            ids = np.empty(int(count.sum()), np.uint32)
            there = np.repeat(short, count)
            ids[there], ids[~there] = own, np.concatenate(longer)
        return ids, np.diff(np.concatenate([[0], np.cumsum(count)])[edges])

    def encode_batch(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another as uint32, n + 1 places where texts begin and end).  With end_id, each text
        ends with it."""
        parts: list[str] = []
        marks: list[tuple[int, int]] = []  # (parts before, id) of ids that do not come from a part
        edges = [0]
        for text in texts:
            if self.extra_any and self.extra_any.search(text):
                for k, piece in enumerate(self.extra_any.split(text)):
                    if k % 2:
                        marks.append((len(parts), self.extra[piece]))
                    else:
                        parts += safe_cuts(piece, BLOCK)
            else:
                parts += safe_cuts(text, BLOCK) if len(text) > BLOCK and not self.find else [text]
            if end_id is not None:
                marks.append((len(parts), end_id))
            edges.append(len(parts) + len(marks))
        ids, counts, at = [], [], 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end]) <= BLOCK):
                size += len(parts[end])
                end += 1
            some, n = self._block(parts[at:end])
            ids.append(some), counts.append(n)
            at = end
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if marks:
            before, own = (np.array(x) for x in zip(*marks, strict=True))
            flat = np.insert(flat, np.concatenate([[0], np.cumsum(count)])[before], own.astype(np.uint32))
            count = np.insert(count, before, 1)
        return flat, np.concatenate([[0], np.cumsum(count)]).astype(np.int64)[edges]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids.  A token may hold a part of a character; bytes are joined first, so parts meet again.
        An id outside the table is an error."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise IndexError("an id is outside the vocabulary")
        some = (ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK))
        return b"".join(self.bytes[spread(self.begins[x], self.widths[x])].tobytes() for x in some)

    def decode_batch(self, ids: np.ndarray, edges: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all texts, n + 1 places where texts begin and end) of what encode_batch gives."""
        return self.decode(ids), np.concatenate([[0], np.cumsum(self.widths[ids])])[edges]

    def offsets(self, texts: list[str], ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Per token of encode_batch(texts), in two columns, the first character in its text and the end: a token that starts
        or ends inside a character covers that whole character."""
        raw = np.frombuffer("".join(texts).encode("utf-8", "replace"), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.repeat(np.cumsum(sizes) - sizes, np.diff(edges))
        end = np.cumsum(self.widths[ids])
        return np.stack([char_of[end - self.widths[ids]] - base, char_of[end - 1] + 1 - base], 1) if len(end) else np.zeros((0, 2), np.int64)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, added: bool = False) -> Codec:
    """One per worker process and vocabulary."""
    return Codec(path, pattern, added)
