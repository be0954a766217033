"""Plain versions of the stages of the pipeline."""

import re

from test_decontaminate import plain_tiles, words
from test_jaccard_join import plain


def exact(rows):
    best = {}
    for i, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        best[norm] = min(best.get(norm, i), i)
    return sorted(best.values())


def near(rows, k, percent):
    judged = plain([(i, t, None) for i, t in rows], k, percent)
    return sorted(i for i, _, head in judged if i == head)


def tiled(text, items):
    own = words(text)
    grams = {tuple(own[i : i + 5]) for i in range(len(own))}
    for _, body in items:
        item = words(body)
        shared = [i for i in range(len(item)) if tuple(item[i : i + 5]) in grams]
        if len(shared) * 5 >= 0.5 * len(item) and item:
            # Only words that can be part of a tile matter; others stop the match.
            pieces, at = [], 0
            known = {tuple(item[i : i + 5]) for i in shared}
            hit = [tuple(own[i : i + 5]) in known for i in range(len(own))]
            keep = [any(hit[max(0, i - 4) : i + 1]) for i in range(len(own))]
            for at, word in enumerate(own):
                pieces.append(word if keep[at] else None)
            text_words = [w for i, w in enumerate(pieces) if w or (i and pieces[i - 1])]
            if plain_tiles(text_words, item, 5) >= 0.5 * len(item):
                return True
    return False
