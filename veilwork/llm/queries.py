"""One query for each operator of this subpackage, over its whole table, and SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import bpe, chat, decontaminate, exact_dedup, language_id, minhash, prefix_trie, quality, secret_scan, sharding, token_counts, url_filter, whitening


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.byte_level_pieces(tokenizer_path("byte_bpe_50k.json"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces).select("doc_id", "n_words", "n_tokens")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [f"shard-{n:04d}" for n in range(512)]
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), shards)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    both = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.joined(F.col("ids")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.grades_of(table(spark, sf_dir, "labels")), n_grades=3)
    return quality.score(docs, model, wanted=2).select("doc_id", "expected_grade", "tail_probability", quality.passes(F.col("tail_probability")).alias("kept"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontaminate.words_hit(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat.format_preferences(chat.short_reply_pairs(table(spark, sf_dir, "conversations")), dealt=True)
    spans = [chat.spans_text(F.col(f"{side}_spans")).alias(f"{side}_spans") for side in ("chosen", "rejected")]
    return records.select("pair_id", "record", "prompt", "chosen", "rejected", *spans)


#: Verdicts by host and beginning of the path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.fold(F.col("doc_id")) == 2)
    prototypes = language_id.learn_prototypes(docs.where(~F.col("held_out")))
    return language_id.predict(docs, prototypes).select("doc_id", "held_out", "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    turns = prefix_trie.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    sequences, convs = prefix_trie.rebuild(turns, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
    nodes = prefix_trie.with_end_digests(*prefix_trie.build(sequences, convs))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in secret_scan.STRONG]
    return found.select("doc_id", *counts, F.sha2(secret_scan.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"), 8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_minhash": op5_minhash,
    "op6_quality": op6_quality,
    "op7_decontaminate": op7_decontaminate,
    "op8_chat": op8_chat,
    "op9_url_filter": op9_url_filter,
    "op10_language_id": op10_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_secrets": op12_secrets,
    "op13_whitening": op13_whitening,
}

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

def _level_sql(level: int) -> str:
    """One level of the path-template tree in SQL: pages p{level} to p{level + 1}."""
    segment = "'**'" if level == url_filter.DEPTH else f"'=' || parts[{level + 1}]"
    return f"""
        s{level} AS (SELECT *, CASE WHEN len(parts) <= {level} THEN '' ELSE {segment} END AS segment FROM p{level}),
        c{level} AS (SELECT host, template, segment, count(*) AS n, count(label) AS l, coalesce(sum(label), 0)::BIGINT AS b FROM s{level} GROUP BY ALL),
        v{level} AS (SELECT *, count(*) OVER w AS children, sum(n) OVER w AS all_n, (sum(l) OVER w)::BIGINT AS all_l, (sum(b) OVER w)::BIGINT AS all_b
                     FROM c{level} WINDOW w AS (PARTITION BY host, template)),
        d{level} AS (SELECT host, template, segment, CASE WHEN segment = '' THEN '' WHEN segment = '**' THEN '/**'
                     WHEN children > {url_filter.CHILDREN} OR (children > 4 AND children >= {url_filter.VARIABLE}::DOUBLE * all_n) THEN '/*'
                     WHEN l = 0 OR l = all_l OR all_b IN (0, all_l) THEN '/~'
                     WHEN abs(b / l - (all_b - b) / (all_l - l)) <= {url_filter.SIMILAR}::DOUBLE * sqrt(all_b / all_l * (1 - all_b / all_l) * (1 / l + 1 / (all_l - l))) THEN '/~'
                     ELSE '/' || replace(substr(segment, 2), '~', '~0') END AS step FROM v{level}),
        p{level + 1} AS (SELECT s.* EXCLUDE (segment, template), s.template || step AS template FROM s{level} s JOIN d{level} d
                         ON s.host = d.host AND s.template = d.template AND s.segment = d.segment),"""


def url_filter_sql() -> str:
    """The verdicts over pages in SQL; longer rules come first, as the longest that fits decides."""
    fits = []
    for says, rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}')", rule, says))
    weight = f"{url_filter.SMOOTHING}::DOUBLE"
    return rf"""
        WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r AS (SELECT *, CASE {" ".join(f"WHEN {f} THEN '{rule}'" for f, rule, _ in fits)} END AS rule,
              CASE {" ".join(f"WHEN {f} THEN '{says}'" for f, _, says in fits)} END AS says FROM u),
        p0 AS (SELECT *, CASE says WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS label, string_split(regexp_replace(path, '^/', ''), '/') AS parts, '' AS template FROM r),
        {"".join(map(_level_sql, range(url_filter.DEPTH + 1)))}
        a AS (SELECT coalesce(sum(label) / nullif(count(label), 0), 0) AS share FROM p0),
        f AS (SELECT *, count(label) OVER t AS l, coalesce(sum(label) OVER t, 0) AS b,
              (coalesce(sum(label) OVER h, 0) + {weight} * share) / (count(label) OVER h + {weight}) AS host_share
              FROM p{url_filter.DEPTH + 1}, a WINDOW t AS (PARTITION BY host, template), h AS (PARTITION BY host))
        SELECT page_id, host, path, rule,
               coalesce(says, CASE WHEN (b + {weight} * host_share) / (l + {weight}) > {url_filter.PURITY}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
        FROM f"""


def _side_sql(side: str) -> str:
    """One side's completions in SQL: turns t from the first difference on, with the spans of replies."""
    return f"""
        {side}_r AS (SELECT pair_id, record, turn, {side}.role AS role, '<|im_start|>' || {side}.role || chr(10) AS head,
            replace(replace({side}.text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10) AS body
            FROM t LEFT JOIN f USING (pair_id) WHERE turn >= first),
        {side}_p AS (SELECT *, sum(length(head || body)) OVER (PARTITION BY pair_id, record ORDER BY turn)::BIGINT AS stop FROM {side}_r),
        {side}_c AS (SELECT pair_id, record, string_agg(head || body, '' ORDER BY turn) AS {side},
            string_agg((stop - length(body))::VARCHAR || '-' || stop, ',' ORDER BY turn) FILTER (role = 'assistant') AS {side}_spans FROM {side}_p GROUP BY ALL),"""


_CHAT_SQL = f"""
        WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1),
        o AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS c,
              coalesce(CASE WHEN turn = last AND role = 'assistant' THEN split_part(text, '. ', 1) ELSE text END, '') AS r
              FROM conversations LEFT JOIN l USING (conv_id) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        t AS (SELECT pair_id, turn, floor(turn / {chat.RECORD_TURNS}.0)::BIGINT AS record, min(struct_pack(role := role, text := c)) AS chosen,
              min(struct_pack(role := role, text := r)) AS rejected FROM o GROUP BY ALL),
        f AS (SELECT pair_id, min(turn) AS first FROM t WHERE chosen IS DISTINCT FROM rejected GROUP BY 1),
        {_side_sql("chosen")}{_side_sql("rejected")}
        p AS (SELECT pair_id, record, string_agg('<|im_start|>' || chosen.role || chr(10) || replace(replace(chosen.text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')
              || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (first IS NULL OR turn < first) AS prompt FROM t LEFT JOIN f USING (pair_id) GROUP BY ALL)
        SELECT pair_id, record, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
               coalesce(chosen_spans, '') AS chosen_spans, coalesce(rejected_spans, '') AS rejected_spans
        FROM p LEFT JOIN chosen_c USING (pair_id, record) LEFT JOIN rejected_c USING (pair_id, record)"""


#: CRC-32 of decimal ids: a fold over the digits, eight steps each.
_CRC = """xor(4294967295, list_reduce([4294967295]::BIGINT[] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, byte:
        list_reduce([xor(crc, byte)]::BIGINT[] || [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

_TRIE_SQL = rf"""
        WITH c AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
        h AS (SELECT *, {_CRC} % 4 AS h, conv_id - conv_id % 20 AS opener FROM c),
        s AS (SELECT h.conv_id, coalesce(o.own[1:h.h], []) || h.own[h.h + 1:] AS path FROM h LEFT JOIN c o ON o.conv_id = h.opener),
        p AS (SELECT conv_id, unnest(range(0, len(path) + 1)) AS depth, path FROM s),
        n AS (SELECT depth, path[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
              coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(p.path) = depth), '') AS ends FROM p GROUP BY 1, 2),
        w AS (SELECT n.*, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END AS saved, k.conv_id IS NULL AS leaf
              FROM n LEFT JOIN (SELECT DISTINCT ON (up) path[1:depth - 1] AS up, conv_id FROM n WHERE depth > 0) k ON k.up = n.path),
        t AS (SELECT path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM
              (SELECT path[1:unnest(range(0, depth + 1))] AS path, saved, leaf FROM w) GROUP BY 1),
        k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1)
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
        FROM n JOIN t ON t.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN n u ON n.depth > 0 AND u.path = n.path[1:n.depth - 1]"""


def secrets_sql() -> str:
    """Spans over documents in SQL: matches placed by the lengths of what lies between them, confirmed by existence."""
    x = secret_scan
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    value = f"length(regexp_extract(m, {{}}, 2)) >= {{}}"
    tests = {
        "assign": (x.ASSIGN, value.format(quote(x.ASSIGN), x.LEAST_VALUE)), "access": (x.ACCESS, f"length(m) >= {x.LEAST_ACCESS}"), "hex": (x.HEX, f"length(m) >= {x.LEAST_HEX}"),
        "ident": (x.IDENT, value.format(quote(x.IDENT), x.LEAST_IDENT)), "endpoint": (x.ENDPOINT, "true"),
        "secret": (x.NAMELESS, f"length(m) BETWEEN {x.NAMELESS_LENGTH[0]} AND {x.NAMELESS_LENGTH[1]} AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"),
    }
    ctes = []
    for kind, (pattern, test) in tests.items():
        ctes.append(f"""{kind}_m AS (SELECT r, unnest(regexp_extract_all(text, {quote(pattern)}, 0)) AS m, unnest(regexp_split_to_array(text, {quote(pattern)})) AS gap, unnest(range(0, len(regexp_split_to_array(text, {quote(pattern)})))) AS i FROM d),
        {kind}_s AS (SELECT r, i, m, (sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS stop FROM {kind}_m),
        {kind}_0 AS (SELECT r, '{kind}' AS kind, {x.KINDS.index(kind)} AS place, stop - length(m) AS start, stop FROM {kind}_s WHERE m IS NOT NULL AND {test})""")
    apart = "SELECT * FROM {0} c WHERE NOT EXISTS (SELECT 1 FROM {1} t WHERE t.r = c.r AND t.start < c.stop AND t.stop > c.start)".format
    near = lambda *kinds: f"EXISTS (SELECT 1 FROM p o WHERE o.r = p.r AND o.scope = p.scope AND abs(o.start - p.start) <= {x.REACH} AND o.kind IN ({', '.join(map(quote, kinds))}))"
    who, what, where = near("access", "ident"), near("assign", "hex", "secret"), near("endpoint")
    text = lambda f: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place){f}, '')"
    strong = "FILTER (WHERE place < 3)"
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), {", ".join(ctes)},
        strong AS (SELECT * FROM assign_0 UNION ALL SELECT * FROM access_0 UNION ALL SELECT * FROM hex_0),
        ident AS ({apart("ident_0", "strong")}), taken AS (SELECT * FROM strong UNION ALL SELECT * FROM ident UNION ALL SELECT * FROM endpoint_0),
        every AS (SELECT * FROM taken UNION ALL {apart("secret_0", "taken")}),
        p AS (SELECT every.*, len(regexp_extract_all(left(text, start), {quote(x.BREAK)}, 0)) AS scope FROM every JOIN d USING (r)),
        ok AS (SELECT * FROM p WHERE place < 3 OR CASE kind WHEN 'secret' THEN {near("access")} OR ({who} AND {where}) WHEN 'ident' THEN {near("assign", "hex")} OR ({what} AND {where}) ELSE {who} AND {what} END)
        SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
               sha256({text(" " + strong)}) AS base_sha256, {text("")} AS spans
        FROM d LEFT JOIN ok USING (r) GROUP BY r, doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op8_chat": _CHAT_SQL,
    "op9_url_filter": url_filter_sql(),
    "op11_prefix_trie": _TRIE_SQL,
    "op12_secrets": secrets_sql(),
}
