"""Token ids of many short units by a byte-level tokenizer.

A unit (``textops.restart_points``) that starts with one blank and ends with a
character that is surely no white space may be followed by another such unit without
any change to either's tokens.  So such units are encoded as a few long texts, and the
tokens are dealt back by their lengths in bytes; all other units are encoded one by one.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOGETHER = 1 << 16


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones
    for themselves, the others by the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class UnitTokenizer:
    """``bytes`` of each id, and ``lists`` of ids.  ``special_as_text``: a special token's string in a text is ordinary text."""

    def __init__(self, file: str, special_as_text: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")            # one core a task
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(file)
        self.whole.encode_special_tokens = special_as_text
        letters, entries = byte_letters(), {}
        with open(file, encoding="utf-8") as f:
            content = json.load(f)
        for token, i in content["model"]["vocab"].items():
            entries[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.special = [added["content"] for added in content.get("added_tokens", [])]
        for added in content.get("added_tokens", []):
            entries.setdefault(added["id"], added["content"].encode())
        self.bytes = pa.array([entries.get(i, b"") for i in range(max(entries) + 1)], pa.large_binary())
        self.length = pc.binary_length(self.bytes).to_numpy(zero_copy_only=False).astype(np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def lists(self, units: pa.Array) -> pa.Array:
        """The ids of each unit (large binary, none null)."""
        n = len(units)
        _, offsets, values = units.buffers()
        at = np.frombuffer(offsets, np.int64)[units.offset:units.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
        start, end = at[:-1], at[1:]
        long_ = np.flatnonzero(end - start >= 3)
        s, e = start[long_], end[long_]
        last, before = data[e - 1], data[e - 2]
        good = (data[s] == 32) & (data[s + 1] != 32) & ((last > 32) & (last < 127) | (last >= 128) & (before >= 0xC3) & (before <= 0xDF))
        joined = np.zeros(n, dtype=bool)
        joined[long_[good]] = True
        for special in self.special:
            joined &= ~pc.match_substring(units, special).to_numpy(zero_copy_only=False)
        which = np.flatnonzero(joined)
        counts, ids = np.zeros(n, np.int64), [np.zeros(0, np.uint32)] * 2
        if len(which):
            one = units.take(pa.array(which))
            ends = np.cumsum(end[which] - start[which])
            _, _, text = one.buffers()
            cut = np.unique(np.append(np.searchsorted(ends, np.arange(TOGETHER, int(ends[-1]), TOGETHER)), len(which) - 1))
            stops = [0, *ends[cut].tolist()]
            found = self._ids([bytes(memoryview(text)[a:b]).decode() for a, b in zip(stops, stops[1:])])
            flat = np.concatenate([np.array(f, np.uint32) for f in found])
            token_ends = np.cumsum(self.length[flat])
            upto = np.searchsorted(token_ends, ends, side="right")
            if len(token_ends) and (token_ends[upto - 1] == ends).all() and token_ends[-1] == ends[-1]:
                counts[which] = np.diff(upto, prepend=0)
                ids[0] = flat
            else:                                                          # a vocabulary that doesn't keep the rule above
                joined[:] = False
        rest = np.flatnonzero(~joined)
        own = self._ids([units[i].as_py().decode() for i in rest.tolist()])
        counts[rest] = [len(x) for x in own]
        out = np.empty(int(counts.sum()), np.uint32)
        of = np.repeat(joined, counts)
        out[of] = ids[0]
        out[~of] = np.concatenate([np.array(x, np.uint32) for x in own]) if own else ids[1]
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts)))), pa.array(out))


class Known:
    """Units seen so far with what belongs to them; at most ``most``, or those of one call."""

    def __init__(self, work, most: int):
        self.work, self.most = work, most
        self.units, *self.columns = work(pa.array([], pa.large_binary()))

    def find(self, units: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
        """(columns of all known units, where the given distinct ones are)."""
        at = pc.index_in(units, value_set=self.units)
        missing = pc.is_null(at).to_numpy(zero_copy_only=False)
        if len(self.units) + missing.sum() > self.most:
            self.units, *self.columns = self.work(units)
            return self.columns, np.arange(len(units))
        where = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if missing.any():
            where[missing] = len(self.units) + np.arange(missing.sum())
            self.units, *self.columns = (pa.concat_arrays(x) for x in zip((self.units, *self.columns), self.work(units.filter(pa.array(missing)))))
        return self.columns, where
