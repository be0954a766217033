import hashlib
import zlib

from pyspark.sql import functions as F

from mailgrid.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    values = [None if v is None else str(v) for v in row]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(nodes):
    """Root, and the (left, right) steps of every leaf."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for leaf_no, at in enumerate(places):
            run, i = runs[at // 16], at % 16
            paths[leaf_no].append(("".join(run[:i]), "".join(run[i + 1 :])))
        places = [at // 16 for at in places]
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def plain(rows):
    """The audit of (doc_id, text, lang, source, n_chars) rows."""
    full = [(i, s, lang, n, t) for i, t, lang, s, n in rows]
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    groups = {}
    for row in sorted(full, key=order):
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([leaf(r) for r in groups[s]]) for s in names}
    root, above = tree([built[s][0] for s in names])
    out = []
    for name, upper in zip(names, above):
        for row, path in zip(groups[name], built[name][1]):
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4]:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                changed = (*row[:4], low)
            folded = leaf(changed)
            for left, right in path + upper:
                folded = sha(left + folded + right)
            proof = sha("".join(a + b for a, b in path + upper))
            out.append(
                (row[0], leaf(row), built[name][0], root, proof, folded, folded == root)
            )
    return out


def check(spark, rows):
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )
    for name in ("_group", "_key", "_digest", "_at", "leaf", "root", "_c0", "witness", "_n"):
        docs = docs.withColumn(name, F.lit("x"))
    got = merkle.audit(docs.repartition(3)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))


def test_messy_rows(spark, messy):
    rows = [(i, t, lang, (None, "", "a", "é", "Z")[n % 5], n if n % 3 else None)
            for n, (i, t, lang) in enumerate(messy)]
    check(spark, rows)


def test_groups_of_all_shapes(spark):
    sizes = {"one": 1, "full": 16, "more": 17, "square": 256, "over": 300, None: 35, "Ä": 2}
    sizes |= {f"s{i}": 1 for i in range(20)}
    rows = [(1000 * g + i * 7 % n, f"Text {i} of {s}", "en", s, i)
            for g, (s, n) in enumerate(sizes.items()) for i in range(n)]
    check(spark, rows)


def test_blocks_are_further_appends(spark):
    n = 2 * merkle.BLOCK + 17
    rows = [(i, f"T{i}", None, "hot" if i > 5 else "cold", i) for i in range(n + 6)]
    check(spark, rows)


def test_lone_leaves_and_a_lone_group(spark):
    check(spark, [(1, "A", "en", "x", 1)])
    check(spark, [(i, "A", "en", f"g{i}", 1) for i in range(3)])
    check(spark, [(i, "A", "en", None, 1) for i in range(18)])


def test_witnesses_fold_to_the_root(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "s") for i in range(40)],
                                 "doc_id long, text string, source string")
    rows = merkle.manifest(docs, ["doc_id", "text"], keep={"kept": F.col("text")})
    rows = rows.withColumn("found", merkle.fold(F.col("leaf"), F.col("witness")))
    got = rows.collect()
    assert all(r["found"] == r["root"] and r["kept"] == f"t{r['doc_id']}" for r in got)
    assert len(got) == 40


def test_no_rows(frame):
    assert merkle.audit(frame([])).count() == 0
