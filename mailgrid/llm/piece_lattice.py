"""The lattice of a pair-merging piece model, as a stream of characters with one surviving path.

Merging gives the pieces t1..tn for a text exactly if every piece merges to itself alone and every
neighbouring pair merges to that pair alone. So a path of the lattice may pass from one piece to
the next only if that pair stays, and of all paths to a position one survives.
"""

NEVER = float("inf")
SHORT = (2, 1)


class Pieces:
    """``ranks`` orders the merges: two parts merge if it has their text, the lowest rank first
    and the leftmost of equals. Single characters are always pieces. Pieces are numbered; a
    character that is no entry of ``ranks`` gets a number when it is first met."""

    def __init__(self, ranks, most=120_000):
        self.ranks, self.most = ranks, most
        self.shared = {p: p for p in ranks}
        self.names, self.numbers, self.steps = [], {}, []
        for piece in ranks:
            steps = self.alone(piece)
            if steps:
                self.add(piece, steps)
        self.reach = max(map(len, self.names), default=1)
        # Which neighbours stay apart, by both numbers.
        self.pairs = {}
        sizes = {}
        for piece in self.names:
            if len(piece) > 2:
                sizes.setdefault(piece[-3:], set()).add(len(piece))
        # Lengths of the pieces with these last three characters, longest first.
        self.tails = {t: (*sorted(s, reverse=True), *SHORT) for t, s in sizes.items()}

    def add(self, piece, steps=((), (), ())):
        self.numbers[piece] = len(self.names)
        self.names.append(piece)
        self.steps.append(steps)
        return len(self.names) - 1

    def alone(self, piece):
        """How a piece comes about: the ranks of its merges in order, and the first and the last
        part before each; None if merging does not lead to it."""
        parts, same = list(piece), self.shared
        ranks, firsts, lasts = [], [], []
        while len(parts) > 1:
            found = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in found if r is not None), default=None)
            if best is None:
                return None
            ranks.append(best)
            firsts.append(same.setdefault(parts[0], parts[0]))
            lasts.append(same.setdefault(parts[-1], parts[-1]))
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return ranks, firsts, lasts

    def stays(self, left, right):
        """Whether the text of both, given by number, is merged to this pair."""
        if len(self.pairs) >= self.most:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.apart(left, right)
        return known

    def apart(self, left, right):
        """Both sides are merged side by side, the lower rank first, as long as no merge across
        them comes before the next one of either side."""
        rank = self.ranks.get
        a, _, lasts = self.steps[left]
        b, firsts, _ = self.steps[right]
        end, begin = self.names[left], self.names[right]
        i = j = 0
        while True:
            low = a[i] if i < len(a) else NEVER
            high = b[j] if j < len(b) else NEVER
            across = rank((lasts[i] if i < len(a) else end) + (firsts[j] if j < len(b) else begin))
            # Equal ranks: the left side comes before the middle, the right side after it.
            if across is not None and across < low and across <= high:
                return False
            if low == high == NEVER:
                return True
            if low <= high:
                i += 1
            else:
                j += 1


class Stream:
    """Feeds text of any length through the lattice, holding a bounded window of it."""

    def __init__(self, lattice):
        self.lattice = lattice
        # Number and length of the last piece of the surviving path to each position.
        self.text, self.last, self.sizes = "", [-1], [0]
        # Positions of the window whose pieces are committed.
        self.committed = 0
        # Room to look for a boundary again; the window itself is ``reach``.
        self.step = max(64, 4 * lattice.reach)
        self.due = self.step

    def push(self, text):
        """Adds text; gives the numbers of the pieces that are final."""
        out = []
        for at in range(0, len(text), self.step):
            self.text += text[at : at + self.step]
            self.extend()
            if len(self.text) >= self.due:
                out += self.commit()
                self.due = len(self.text) + self.step
        return out

    def extend(self):
        text, last, sizes, lattice = self.text, self.last, self.sizes, self.lattice
        tails, number, stays = lattice.tails.get, lattice.numbers.get, lattice.pairs.get
        for end in range(len(last), len(text) + 1):
            for size in tails(text[end - 3 : end], SHORT) if end > 2 else SHORT:
                begin = end - size
                if begin < 0:
                    continue
                piece = number(text[begin:end])
                if piece is None:
                    if size > 1:
                        continue
                    piece = lattice.add(text[begin:end])
                if begin:
                    left = last[begin]
                    known = stays(left << 32 | piece)
                    if not (lattice.stays(left, piece) if known is None else known):
                        continue
                last.append(piece)
                sizes.append(size)
                break
            else:
                raise ValueError("no piece ends here")

    def commit(self):
        """Follows all surviving paths back until they meet and releases what lies before."""
        paths = set(range(max(0, len(self.text) - self.lattice.reach), len(self.text) + 1))
        while len(paths) > 1:
            end = max(paths)
            paths.remove(end)
            paths.add(end - self.sizes[end])
        meet = paths.pop()
        if not meet:
            return []
        final = self.path(meet)
        # The next piece is still judged by the one before it, which stays in the window whole.
        keep = self.sizes[meet]
        self.text = self.text[meet - keep :]
        self.last = [-1] * keep + self.last[meet:]
        self.sizes = [0] * keep + self.sizes[meet:]
        self.committed = keep
        return final

    def path(self, end):
        pieces, last, sizes = [], self.last, self.sizes
        while end > self.committed:
            pieces.append(last[end])
            end -= sizes[end]
        pieces.reverse()
        return pieces

    def finish(self):
        """The pieces that are left."""
        return self.path(len(self.text))

    def rewind(self, size):
        """Goes back to the first ``size`` characters, if nothing is committed; a word that
        begins alike goes on there. Says whether it could."""
        if self.committed:
            return False
        self.text = self.text[:size]
        del self.last[size + 1 :], self.sizes[size + 1 :]
        self.due = self.step
        return True
