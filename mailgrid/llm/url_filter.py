"""URL filters with a bit-parallel wildcard automaton.

All glob rules are packed into the bits of a few 64-bit words (Shift-And). One pass over the
bytes of a canonical URL simulates every rule at once; a star is a bit that stays set. Numpy
takes that step for all URLs of a batch together.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

# Stands between host and path in a canonical URL; no UTF-8 text has this byte.
CUT = b"\xff"


class Globs:
    """Bytes with ``*`` (any run, also empty) and ``?`` (any one byte); each matches a whole
    text."""

    def __init__(self, patterns):
        self.n = len(patterns)
        self.always = np.array([bool(p) and not p.strip(b"*") for p in patterns], bool)
        self.empty = np.array([not p.strip(b"*") for p in patterns], bool)
        literals = [len(p.replace(b"*", b"")) for p in patterns]
        words = self.words = max(1, -(-sum(literals) // 64))
        self.step = np.zeros((256, words), np.uint64)
        self.stay, self.first, self.begin, self.anywhere = np.zeros((4, words), np.uint64)
        self.last = np.full(self.n, -1)
        bit = 0

        def put(mask, at):
            mask[at // 64] |= np.uint64(1) << np.uint64(at % 64)

        for number, pattern in enumerate(patterns):
            start, star = True, False
            for byte in pattern:
                if byte == 0x2A:
                    if start:
                        star = True
                    else:
                        put(self.stay, bit - 1)
                    continue
                for value in range(256) if byte == 0x3F else (byte,):
                    put(self.step[value], bit)
                if start:
                    put(self.first, bit)
                    put(self.anywhere if star else self.begin, bit)
                    start = False
                self.last[number] = bit
                bit += 1

    def match(self, texts):
        """Boolean matrix, texts by patterns."""
        sizes = np.array([len(t) for t in texts], np.int64)
        found = np.zeros((len(texts), self.n), bool)
        found[:, self.always] = True
        found[np.ix_(sizes == 0, self.empty)] = True
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        state = np.zeros((len(texts), self.words), np.uint64)
        final = np.zeros_like(state)
        one, top = np.uint64(1), np.uint64(63)
        alive = int(np.searchsorted(-sizes, 0, "left"))
        for at in range(int(sizes[0]) if len(sizes) else 0):
            now = int(np.searchsorted(-sizes[:alive], -at, "left"))
            final[now:alive] = state[now:alive]
            alive, old = now, state[:now]
            new = old << one
            new[:, 1:] |= old[:, :-1] >> top
            new &= ~self.first
            new |= self.anywhere | self.begin if at == 0 else self.anywhere
            new &= self.step[data[starts[:alive] + at]]
            new |= old & self.stay
            state[:alive] = new
        final[:alive] = state[:alive]
        for number, bit in enumerate(self.last):
            if bit >= 0:
                hit = final[:, bit // 64] >> np.uint64(bit % 64) & one
                found[order, number] |= hit.astype(bool)
        return found


def host_and_path(url):
    """Lower-cased (A-Z) host and path of a URL; both empty without ``://``."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(LOWER), slash + path


LOWER = {c: c + 32 for c in range(65, 91)}


def judge_urls(pages, rules, globs, key="page_id", url="url"):
    """One row per page: key, host, path, rule, verdict.

    ``rules`` are (verdict, host, path): a rule fits its host and all subdomains if the path
    starts with the rule's; of fitting rules the longest host and path wins, of equally long
    ones a block. Without a rule the URL is blocked if one of ``globs``, which match the whole
    host, fits, and allowed otherwise. A NULL url or one without ``://`` has an empty host and
    path, which no rule fits. Rules and globs go to every task: they are settings, not data.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1], r[2]))
    own = []
    for _, host, path in ranked:
        tail = host.encode() + CUT + path.encode() + b"*"
        own += [tail, b"*." + tail]
    machine = Globs(own + [g.encode() + CUT + b"*" for g in globs])
    names = [h + p for _, h, p in ranked]
    verdicts = [v for v, _, _ in ranked]

    def run(batches):
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
            hits = machine.match([h.encode() + CUT + p.encode() for h, p in parts])
            fit = hits[:, 0 : len(own) : 2] | hits[:, 1 : len(own) : 2]
            spam = hits[:, len(own) :].any(axis=1)
            rule, verdict = [], []
            for row, bad in zip(fit, spam):
                at = int(row.argmax()) if row.any() else None
                rule.append(None if at is None else names[at])
                verdict.append(("block" if bad else "allow") if at is None else verdicts[at])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array(rule, pa.string()),
                    pa.array(verdict, pa.string()),
                ],
                [key, "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(key, F.col(url).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")
