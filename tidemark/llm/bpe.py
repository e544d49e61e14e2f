"""Byte-level BPE on ragged numpy arrays: a whole batch of pre-tokens is merged in step."""

import json
import re

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

# Fixed values of the byte-level scheme: its pre-token pattern and its white space.
SPACE = "\t-\r \x85\xa0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    + f"| ?[^{SPACE}" + r"\p{L}\p{N}]+" + f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
# A blank between two characters that are surely no white space always starts a pre-token.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def split_pieces(text):
    """Cut a text before single blanks; no pre-token crosses a cut.

    Every piece but the first stands for itself with a blank before it.
    """
    if not text:
        return []
    plain = not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ")
    return text.split(" ") if plain and not _OTHER.search(text) else _CUT.split(text)


def byte_letters():
    """The letter by which the vocabulary file writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return letters


# Beyond these letters Unicode versions differ on what a letter is; the library that
# defines the tokens then says where such a piece is cut.
_NEWER = re.compile("[^\x00-\u052f\u2010-\u2027\u2030-\u205e]")


class Model:
    """Tables of a byte-level BPE file; small and picklable, so it can be broadcast."""

    def __init__(self, text):
        data = json.loads(text)
        if data["model"]["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE file is needed")
        letter = byte_letters()
        byte = {c: b for b, c in letter.items()}
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.byte_id = np.array([vocab[letter[b]] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        self._hash_pairs(keys)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        pieces = [b""] * self.size
        for piece, number in vocab.items():
            pieces[number] = bytes(byte[c] for c in piece)
        for piece, number in self.special.items():
            pieces[number] = piece.encode()
        self.pieces = pieces

    @classmethod
    def load(cls, path):
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def _hash_pairs(self, keys):
        """An open hash table of the pairs as two arrays."""
        self.shift = np.uint64(64 - (4 * len(keys)).bit_length())
        size = 1 << (64 - int(self.shift))
        self.slot_key, self.slot_rank = np.full(size, -1, dtype=np.int64), np.full(size, len(keys), dtype=np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.slot_key[at] >= 0:
                at = (at + 1) % size
            self.slot_key[at], self.slot_rank[at] = key, rank

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left, right):
        """Rank of each pair; ``len(merged)`` where the pair doesn't merge."""
        keys = left * self.size + right
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], len(self.merged))
        left_over = np.flatnonzero((found != keys) & (found >= 0))
        at = at[left_over]
        while len(left_over):
            at = (at + 1) % len(self.slot_key)
            found, wanted = self.slot_key[at], keys[left_over]
            out[left_over] = np.where(found == wanted, self.slot_rank[at], len(self.merged))
            go_on = (found != wanted) & (found >= 0)
            left_over, at = left_over[go_on], at[go_on]
        return out

    def merge(self, flat, lengths):
        """Merge runs of symbols till no pair merges: symbols left, and their number by run.

        In a round every run takes its own lowest rank and merges all places of
        it, from left to right where they overlap. Runs that are done leave.
        """
        none = len(self.merged)
        done_flat, done_run = [], []
        run = np.repeat(np.arange(len(lengths)), lengths)
        flat = np.asarray(flat, dtype=np.int64)
        out_n = np.zeros(len(lengths), dtype=np.int64)
        rank = np.full(len(flat), none)
        changed = np.flatnonzero(run[1:] == run[:-1])
        while len(flat):
            rank[changed] = self.ranks(flat[changed], flat[changed + 1])
            same = run[1:] == run[:-1]
            heads = np.flatnonzero(np.concatenate(([True], ~same)))
            best = np.minimum.reduceat(rank, heads)
            each = np.diff(np.append(heads, len(flat)))
            best = np.repeat(best, each)
            ended = best == none
            if ended.any():
                done_flat.append(flat[ended])
                done_run.append(run[ended])
                live = ~ended
                flat, run, rank, best = flat[live], run[live], rank[live], best[live]
                changed = changed[:0]
                if not len(flat):
                    break
            hit = rank == best
            # Of neighbouring hits (a pair of equal symbols) every other one counts.
            start = hit & ~np.concatenate(([False], hit[:-1]))
            place = np.arange(len(hit))
            odd = (place - np.maximum.accumulate(np.where(start, place, 0))) % 2
            hit &= odd == 0
            flat = np.where(hit, self.merged[np.minimum(rank, none - 1)], flat)
            keep = ~np.concatenate(([False], hit[:-1]))
            # The pairs that a merged symbol begins or ends are new.
            new = hit.copy()
            new[:-1] |= hit[1:]
            flat, run, rank, new = flat[keep], run[keep], rank[keep], new[keep]
            last = np.append(run[1:] != run[:-1], True)
            rank[last] = none
            changed = np.flatnonzero(new & ~last)
        if done_run:
            flat, run = np.concatenate(done_flat), np.concatenate(done_run)
            by = np.argsort(run, kind="stable")
            flat = flat[by]
            out_n = np.bincount(run, minlength=len(lengths))
        return flat, out_n


class Encoder:
    """Encodes pieces of texts; a worker keeps one."""

    def __init__(self, model):
        self.model = model
        self._known, self._other = regex.compile(PATTERN).findall, ByteLevel(add_prefix_space=False)
        self.special = re.compile("(" + "|".join(map(re.escape, model.special)) + ")") if model.special else None

    def find(self, text):
        if _NEWER.search(text):
            return [text[a:b] for _, (a, b) in self._other.pre_tokenize_str(text)]
        return self._known(text)

    def encode(self, pieces):
        """Ids of all pieces, one after the other, and their number by piece."""
        pretokens, owner, fixed = [], [], []
        for k, piece in enumerate(pieces):
            marked = self.special and self.special.search(piece)
            for i, part in enumerate(self.special.split(piece) if marked else (piece,)):
                if i % 2:
                    fixed.append((len(owner), self.model.special[part]))
                    pretokens.append(b"")
                    owner.append(k)
                elif part:
                    found = [p.encode() for p in self.find(part)]
                    pretokens += found
                    owner += [k] * len(found)
        lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        data = self.model.byte_id[np.frombuffer(b"".join(pretokens), dtype=np.uint8)]
        flat, n = self.model.merge(data, lengths)
        if fixed:
            at = np.cumsum(n)[[f[0] for f in fixed]]
            flat = np.insert(flat, at, [f[1] for f in fixed])
            n[[f[0] for f in fixed]] = 1
        return flat, np.bincount(np.array(owner, dtype=np.int64), weights=n, minlength=len(pieces)).astype(np.int64)
