"""The registered queries of the operators, with SQL where SQL can state the result."""

import public_tokenizers

from mailgrid.llm import (
    decontaminate,
    exact_dedup,
    fingerprints,
    jaccard_join,
    language_id,
    merkle,
    periodic_runs,
    quality,
    sentencepiece_codec,
    token_counts,
    toxicity,
    url_filter,
    warc,
)
from mailgrid.llm.common import table

QUERIES, ORACLES = {}, {}


def query(sql=None):
    """Registers a function of (spark, folder) under its own name."""

    def add(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return add


# Fixed rules of the query: verdict, host, path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
# Host globs of unwanted sites, for URLs that no rule fits.
UNWANTED = ["*adult*", "*casino*", "*pills*", "*-bets*", "*ads-track*", "*spam*"]


@query("""
    with cut as (
        select page_id,
               case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3)
                    else '' end as rest
        from pages),
    parts as (
        select page_id,
               translate(regexp_extract(rest, '^[^/?#]*'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
        from cut),
    ruled as (
        select *, case
            when (host = 'example.net' or ends_with(host, '.example.net'))
                and starts_with(path, '/en/') then 'example.net/en/'
            when (host = 'example.com' or ends_with(host, '.example.com'))
                and starts_with(path, '/de/') then 'example.com/de/'
            when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/')
                then 'org/fr/'
            when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/')
                then 'net/' end as rule
        from parts)
    select page_id, host, path, rule, case
        when rule in ('net/', 'example.com/de/') then 'block'
        when rule is not null then 'allow'
        when regexp_matches(host, 'adult|casino|pills|-bets|ads-track|spam') then 'block'
        else 'allow' end as verdict
    from ruled
""")
def op3_url_filter(spark, folder):
    return url_filter.judge_urls(table(spark, folder, "pages"), RULES, UNWANTED)


@query()
def op4_token_counts(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(table(spark, folder, "documents"), path, limit=1024)


@query("""
    with norm as (
        select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'))
            as text_sha256
        from documents)
    select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
           doc_id = min(doc_id) over same as kept, text_sha256
    from norm window same as (partition by text_sha256)
""")
def op7_exact_dedup(spark, folder):
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


@query()
def op9_sentencepiece(spark, folder):
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encode_texts(table(spark, folder, "documents"), path)


@query()
def op1_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return toxicity.predict_toxicity(docs, labels)


@query("""
    with sized as (
        select page_id, strlen(coalesce(html, '')) as payload_bytes,
               sha1(coalesce(html, '')) as payload_digest
        from pages),
    tops as (
        select payload_digest, max(page_id) as top from sized
        where payload_bytes >= 1000 group by payload_digest)
    select page_id, payload_bytes, payload_digest,
           case when top <> page_id then 'revisit' else 'response' end as record_type,
           case when top <> page_id then top end as refers_to, 'ok' as status
    from sized left join tops using (payload_digest)
""")
def op2_warc(spark, folder):
    return warc.archive_round_trip(table(spark, folder, "pages"))


@query()
def op5_language_id(spark, folder):
    return language_id.predict_languages(table(spark, folder, "documents"))


@query()
def op10_quality(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality.predict_quality(docs, labels)


@query()
def op6_decontamination(spark, folder):
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.contaminated_pairs(docs, items)


@query()
def op8_jaccard_join(spark, folder):
    return jaccard_join.jaccard_components(table(spark, folder, "documents"), 3, 90)


@query()
def op11_periodic_runs(spark, folder):
    return periodic_runs.run_digests(table(spark, folder, "documents"))


def tree_sql(name, leaves, levels):
    """CTEs of a tree over the rows (grp, pos, h) of ``leaves``: the nodes of every level, and
    ``<name>_path`` with the lists of digests left and right of each leaf's node per level."""
    parts = [
        f"{name}_0 as materialized (select grp, pos, h, count(*) over (partition by grp) as n"
        f" from {leaves})"
    ]
    for k in range(levels):
        parts.append(f"""{name}_{k + 1} as materialized (
            select grp, pos // 16 as pos,
                   case when any_value(n) > 1 then sha256(string_agg(h, '' order by pos))
                        else any_value(h) end as h,
                   (any_value(n) + 15) // 16 as n, list(h order by pos) as run,
                   any_value(n) > 1 as real
            from {name}_{k} group by grp, pos // 16)""")
    joins, steps = "", []
    for k in range(levels):
        span = 16**k
        joins += f""" join {name}_{k + 1} as r{k}
            on r{k}.grp is not distinct from l.grp and r{k}.pos = l.pos // {16 * span}"""
        place = f"(l.pos // {span}) % 16"
        steps += [
            f"case when r{k}.real then array_to_string(r{k}.run[1:{place}], '') end as a{k}",
            f"case when r{k}.real then array_to_string(r{k}.run[{place} + 2:], '') end as b{k}",
        ]
    parts.append(
        f"{name}_path as materialized (select l.grp, l.pos, {', '.join(steps)}"
        f" from {name}_0 as l {joins})"
    )
    return ",\n".join(parts)


def field_sql(value):
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def leaf_sql(text):
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return f"sha256({' || '.join(map(field_sql, fields))})"


# Room for 16**6 documents of a source and 16**4 sources.
LEAF_LEVELS, SOURCE_LEVELS = 6, 4
# The crc32 of a text of ASCII digits, bit by bit.
CRC_BITS = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
SMALL_LETTERS = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def manifest_sql():
    own = [(f"p.a{k}", f"p.b{k}") for k in range(LEAF_LEVELS)]
    over = [(f"q.a{k}", f"q.b{k}") for k in range(SOURCE_LEVELS)]
    proof = " || ".join(f"coalesce({side}, '')" for step in own + over for side in step)
    # Each step is a column of its own, or the text would double at every level.
    fold = ""
    for i in range(len(own + over)):
        fold += f""",
            fold_{i} as materialized (
                select * exclude (f), case when list_extract(lefts, {i + 1}) is null then f
                    else sha256(list_extract(lefts, {i + 1}) || f || list_extract(rights, {i + 1}))
                    end as f
                from {'fold_' + str(i - 1) if i else 'started'})"""
    lefts = ", ".join(left for left, _ in own + over)
    rights = ", ".join(right for _, right in own + over)
    return f"""
    with crc_table as (
        select list_transform(range(256), lambda n:
            list_reduce(list_prepend(n, range(8)), lambda c, i: {CRC_BITS})) as crcs),
    keyed as (
        select doc_id as hit_id, xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(range(1, length(doc_id::varchar) + 1),
                lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint)),
            lambda c, b: xor(c >> 8, list_extract(crcs, (xor(c, b) & 255) + 1)))) % 5 = 0 as hit
        from (select distinct doc_id from documents), crc_table),
    rows as (
        select d.doc_id, source as grp, {leaf_sql('text')} as h,
               case when hit then {leaf_sql(SMALL_LETTERS)} else {leaf_sql('text')} end as f
        from documents as d left join keyed as k on k.hit_id = d.doc_id),
    leaves as materialized (
        select *, row_number() over (partition by grp order by doc_id nulls first, h) - 1 as pos
        from rows),
    {tree_sql('low', 'leaves', LEAF_LEVELS)},
    subroots as materialized (
        select '' as grp, grp as source, h,
               row_number() over (order by grp nulls first) - 1 as pos
        from low_{LEAF_LEVELS}),
    {tree_sql('top', 'subroots', SOURCE_LEVELS)},
    started as materialized (
        select l.doc_id, l.h as leaf, s.h as subroot, t.h as root, sha256({proof}) as proof_sha256,
               [{lefts}] as lefts, [{rights}] as rights, l.f
        from leaves as l
        join low_path as p on p.grp is not distinct from l.grp and p.pos = l.pos
        join subroots as s on s.source is not distinct from l.grp
        join top_path as q on q.pos = s.pos
        cross join top_{SOURCE_LEVELS} as t){fold}
    select doc_id, leaf, subroot, root, proof_sha256, f as folded_root, f = root as verified
    from fold_{LEAF_LEVELS + SOURCE_LEVELS - 1}
    """


@query(manifest_sql())
def op12_merkle_manifest(spark, folder):
    return merkle.audit(table(spark, folder, "documents"))


@query()
def op13_fingerprints(spark, folder):
    return fingerprints.edit_likeness(table(spark, folder, "documents"))
