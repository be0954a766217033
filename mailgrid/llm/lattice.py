"""Byte-pair segmentation as a shortest-path lattice.

Pair merging yields t1..tn for a text exactly if every piece merges to itself alone and every
neighbouring pair merges to that pair alone. So the segmentation of each prefix follows from
shorter prefixes: its last piece is the one vocabulary entry that ends there and gets along with
the last piece of the prefix before it. One such entry exists for each prefix.
"""

# Prefixes a worker keeps before it starts anew; results do not depend on it.
REMEMBERED = 250_000
# Longer words are worked out without keeping their prefixes.
LONG = 48


class Lattice:
    """``rank(a, b)`` orders the merges, None where a and b do not merge; ``vocabulary`` holds
    every piece a merge can make. Single symbols are always pieces."""

    def __init__(self, vocabulary, rank):
        self.rank = rank
        self.pieces = {p for p in vocabulary if len(p) > 1 and self.merge(p) == [p]}
        self.reach = max((len(p) for p in self.pieces), default=1)
        self.pairs = {}
        sizes = {}
        for piece in self.pieces:
            if len(piece) > 2:
                sizes.setdefault(piece[-3:], set()).add(len(piece))
        # Lengths of the pieces with these last three symbols, longest first.
        self.tails = {t: (*sorted(s, reverse=True), 2, 1) for t, s in sizes.items()}
        # Of every prefix met: 256 * number of pieces + length of the last one.
        self.known = {}

    def merge(self, text):
        """Plain pair merging of a short text: the lowest rank first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank(a, b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left, right):
        """Whether the pair stays as it is when its text is merged."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return found

    def last_size(self, text, end, last, base=0):
        """Length of the last piece of text[:end]; last[i - base] is that of text[:i]."""
        for size in self.tails.get(text[max(0, end - 3) : end], (2, 1)):
            begin = end - size
            if begin < base:
                continue
            piece = text[begin:end]
            if size == 1 or piece in self.pieces:
                before = last[begin - base]
                if not before or self.fits(text[begin - before : begin], piece):
                    return size
        raise ValueError("no piece ends here")

    def prefix_counts(self, text):
        """Number of pieces of every prefix, the empty one first."""
        last, count = [0], [0]
        for end in range(1, len(text) + 1):
            size = self.last_size(text, end, last)
            last.append(size)
            count.append(count[end - size] + 1)
        return count

    def word(self, text):
        """256 * pieces + length of the last piece of a short text; fills ``known`` with the
        same for all its prefixes, which other words share."""
        known, tails, pieces, pairs = self.known, self.tails, self.pieces, self.pairs
        n = len(text)
        value = known.get(text)
        if value is not None or not n:
            return value or 0
        if len(known) > REMEMBERED:
            known.clear()
        done = n - 1
        while done and text[:done] not in known:
            done -= 1
        for end in range(done + 1, n + 1):
            for size in tails.get(text[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                begin = end - size
                if begin < 0:
                    continue
                piece = text[begin:end]
                if size > 1 and piece not in pieces:
                    continue
                if not begin:
                    value = 256 + size
                    break
                before = known[text[:begin]]
                left = text[begin - (before & 255) : begin]
                fits = pairs.get((left, piece))
                if fits if fits is not None else self.fits(left, piece):
                    value = (before | 255) + 1 + size
                    break
            known[text[:end]] = value
        return value
