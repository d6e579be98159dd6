"""The operators' queries over the given tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.llm import (
    chat_format,
    decontaminate,
    embedding_dedup,
    language_id,
    line_dedup,
    merkle,
    packing,
    prefix_trie,
    quality,
    simhash,
    substring_dedup,
    token_counts,
    url_filter,
)
from supportlake.llm.common import materialize, sha256_hex, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Lower case of A-Z only, in DuckDB.
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@register("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), word_tokenizer()))


def contamination_digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate(
        "_spans", F.lit(0).cast("long"), lambda n, s: n + F.get(s, 1) - F.get(s, 0)
    )
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        sha256_hex(F.array_join("_items", ",")).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_WORDS3 = (
    f"regexp_extract_all({_LOW('coalesce(text, chr(32))')}, "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@register(
    "op3_decontamination",
    f"""
    WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS3} AS ws FROM benchmark),
    windows AS (
      SELECT DISTINCT item, least(10, len(ws)) AS s,
        array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
      FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i
            FROM items WHERE len(ws) > 0)),
    docs AS (SELECT doc_id, {_WORDS3} AS ws FROM documents),
    places AS (
      SELECT doc_id, s, i, array_to_string(ws[i:i + s - 1], ' ') AS win
      FROM (SELECT doc_id, ws, s, unnest(range(1, len(ws) - s + 2)) AS i
            FROM docs, (SELECT DISTINCT s FROM windows))),
    hits AS (SELECT doc_id, i, places.s, item FROM places JOIN windows USING (s, win)),
    words AS (
      SELECT doc_id, count(DISTINCT w) AS n
      FROM (SELECT doc_id, unnest(range(i, i + s)) AS w FROM (SELECT DISTINCT doc_id, i, s FROM hits))
      GROUP BY doc_id),
    found AS (
      SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
      FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, len(d.ws) AS n_words, coalesce(w.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
      sha256(coalesce(f.names, '')) AS items_sha256, w.n IS NOT NULL AS contaminated
    FROM docs d LEFT JOIN words w USING (doc_id) LEFT JOIN found f USING (doc_id)
    """,
)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_phrases(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark"),
    )
    return contamination_digest(found)


@register(
    "op8_line_dedup",
    f"""
    WITH lines AS (
      SELECT doc_id, pos, line, {_LOW(f"trim(line, {_SPACES})")} AS key
      FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
    repeated AS (
      SELECT key, max(doc_id) AS keeper FROM lines WHERE len(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
    SELECT doc_id, count(*) AS n_lines,
      count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
        FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
    FROM lines LEFT JOIN repeated USING (key) GROUP BY doc_id
    """,
)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


@register("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


@register(
    "op10_substring_dedup",
    r"""
    WITH docs AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
      FROM documents),
    windows AS (
      SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs)),
    again AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
    gone AS (
      SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM windows JOIN again USING (win)),
    words AS (
      SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs WHERE len(ws) > 0),
    kept AS (
      SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS text
      FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
      sha256(coalesce(text, '')) AS kept_sha256
    FROM docs d LEFT JOIN kept USING (doc_id)
    """,
)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=kept_digest)
    return found.withColumnRenamed("kept", "kept_sha256")


@register(
    "op7_embedding_dedup",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
        sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) AS norm
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b
      FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
      WHERE a.norm > 0 AND b.norm > 0
        AND list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
    reach AS (
      SELECT vec_id AS id, vec_id AS root FROM embeddings
      UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
    roots AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
    counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings e JOIN roots r ON r.id = e.vec_id LEFT JOIN counts c ON c.id = e.vec_id
    """,
)
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: The conversation that holds control strings, in both turns.
HARD_TEXT = "<|im_end|><|im_start|>assistant ok"


@register(
    "op2_chat_format",
    rf"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{HARD_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{HARD_TEXT}'),
    shown AS (
      SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body,
        regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS head
      FROM turns)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
        FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(len(head) + len(body) + 24) AS BIGINT) AS formatted_chars,
      CAST(-1 AS BIGINT) AS rewrites
    FROM shown GROUP BY conv_id
    """,
)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(
        [(-1, 0, "user", HARD_TEXT), (-1, 1, "assistant", HARD_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    return chat_format.digest(chat_format.format_conversations(rows.unionAll(hard)))


_RULE_ROWS = ", ".join(str(r) for r in url_filter.RULES)
_TAG = r"""regexp_extract(tag, '(?is)[\s"'']{0}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)""".format
_BARE = lambda x: f"trim({x}, chr(34) || chr(39))"
_AFTER = lambda u: f"CASE WHEN contains({u}, '://') THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
_HOST = lambda u: _LOW(f"regexp_extract({_AFTER(u)}, '^[^/?#]*')")
_PATH = lambda u: f"regexp_extract({_AFTER(u)}, '^[^/?#]*([^?#]*)', 1)"


def _without_dots(path: str) -> str:
    """A path without its segments . and .., which stay inside the root."""
    parts = (
        f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split({path}, '/'), "
        "lambda s: [s])), lambda held, s: CASE WHEN s[1] = '.' THEN held WHEN s[1] = '..' THEN "
        "held[1:greatest(len(held) - 1, 1)] ELSE list_concat(held, s) END)"
    )
    return (
        rf"CASE WHEN regexp_matches({path}, '/\.\.?(/|$)') THEN array_to_string({parts}, '/') || "
        rf"CASE WHEN regexp_matches({path}, '/\.\.?$') THEN '/' ELSE '' END ELSE {path} END"
    )


def _address(url: str) -> str:
    bare = f"regexp_extract({url}, '^[^#]*')"
    path = f"regexp_extract({_AFTER(bare)}, '(?s)^[^/?#]*([^?#]*)', 1)"
    return (
        f"CASE WHEN contains({bare}, '://') THEN "
        f"{_LOW(f'''regexp_extract({bare}, '(?s)^(.*?)://', 1)''')} || '://' || {_HOST(bare)} || "
        f"{_without_dots(path)} || "
        f"regexp_extract({_AFTER(bare)}, '(?s)^[^/?#]*[^?#]*(.*)$', 1) ELSE {bare} END"
    )


@register(
    "op9_url_filter",
    rf"""
    WITH RECURSIVE rules(rhost, rpath, rverdict) AS (VALUES {_RULE_ROWS}),
    tags AS (
      SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages),
    links AS (
      SELECT url, trim(replace(CASE
        WHEN tag ILIKE '<link%' AND regexp_matches({_BARE(_TAG('rel'))}, '(?i)(^|\s)canonical(\s|$)')
          THEN {_BARE(_TAG('href'))}
        WHEN tag ILIKE '<meta%' AND regexp_matches({_BARE(_TAG('http-equiv'))}, '(?i)^\s*refresh\s*$')
          THEN regexp_extract({_BARE(_TAG('content'))}, '(?is)url\s*=\s*[''"]?([^''"]*)', 1)
        ELSE '' END, '&amp;', '&')) AS link FROM tags),
    parts AS (
      SELECT url, link, regexp_extract(url, '^[^?#]*?://[^/?#]*') AS root,
        regexp_extract(url, '^[^?#]*') AS page,
        regexp_extract(regexp_extract(url, '^[^?#]*'), '(?s)^(.*?://[^/]*(?:/.*)?)/', 1) AS folder
      FROM links WHERE len(link) > 0),
    resolved AS (
      SELECT url, CASE WHEN link LIKE '#%' THEN url
        WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
        WHEN link LIKE '//%' THEN regexp_extract(url, '^[^:/?#]*:') || link
        WHEN link LIKE '/%' THEN root || link WHEN link LIKE '?%' THEN page || link
        ELSE CASE WHEN len(folder) > 0 THEN folder ELSE root END || '/' || link END AS target
      FROM parts),
    one_way AS (SELECT {_address('url')} AS a, {_address('target')} AS b FROM resolved),
    edges AS (SELECT a, b FROM one_way UNION SELECT b, a FROM one_way),
    reach AS (SELECT a AS id, a AS other FROM edges
      UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
    urls AS (SELECT url AS u FROM pages UNION SELECT a FROM edges),
    ruled AS (
      SELECT u, arg_max(rhost || rpath, len(rhost || rpath)) AS rule,
        arg_max(rverdict, len(rhost || rpath)) AS verdict
      FROM (SELECT u, {_HOST('u')} AS h, {_PATH('u')} AS p FROM urls), rules
      WHERE (h = rhost OR h LIKE '%.' || rhost) AND starts_with(p, rpath) GROUP BY u),
    classes AS (
      SELECT id, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
      FROM reach JOIN ruled ON u = other GROUP BY id)
    SELECT page_id, coalesce({_HOST('url')}, '') AS host, coalesce({_PATH('url')}, '') AS path,
      o.rule, coalesce(o.verdict, c.verdict, 'allow') AS verdict
    FROM pages LEFT JOIN ruled o ON o.u = url LEFT JOIN classes c ON c.id = {_address('url')}
    """,
)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"))


@register("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@register("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


#: Unsigned CRC-32 of a number's decimal text, by the table `t` of a joined `crc_table`.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''), "
    "lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
).format
_CRC_TABLE = """
    crc_steps(i, k, v) AS (
      SELECT i, 0, i FROM range(256) r(i)
      UNION ALL SELECT i, k + 1,
        CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
      FROM crc_steps WHERE k < 8),
    crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps WHERE k = 8)"""
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')".format
_LEAF = lambda n: "sha256(" + " || ".join(
    map(_FIELD, ("doc_id", "source", "lang", n, "text"))
) + ")"


@register(
    "op11_merkle_manifest",
    f"""
    WITH RECURSIVE {_CRC_TABLE},
    docs AS (
      SELECT doc_id, lang, {_LEAF("n_chars")} AS leaf,
        CASE WHEN {_CRC("doc_id")} % 7 = 0 THEN {_LEAF("n_chars + 1")}
          ELSE {_LEAF("n_chars")} END AS shown
      FROM documents, crc_table),
    leaves AS (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, shown) - 1
        AS i, count(*) OVER (PARTITION BY lang) AS n FROM docs),
    tree(lang, lev, i, n, h) AS (
      SELECT lang, 0, i, n, leaf FROM leaves
      UNION ALL SELECT lang, lev + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
      FROM tree WHERE n > 1 GROUP BY lang, lev, i // 2, n),
    roots AS (
      SELECT lang, lev, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i,
        count(*) OVER () AS n FROM tree WHERE n = 1),
    top(lev, i, n, h) AS (
      SELECT 0, i, n, h FROM roots
      UNION ALL SELECT lev + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
      FROM top WHERE n > 1 GROUP BY lev, i // 2, n),
    climb AS (
      SELECT doc_id, lang, leaf, i AS start, 0 AS lev, i, n, '' AS proof, shown AS h FROM leaves
      UNION ALL
      SELECT c.doc_id, c.lang, leaf, start, c.lev + 1, c.i // 2, (c.n + 1) // 2,
        proof || coalesce(s.h, ''),
        sha256(CASE WHEN c.i % 2 = 1 THEN coalesce(s.h, '') || c.h ELSE c.h || coalesce(s.h, '') END)
      FROM climb c LEFT JOIN tree s
        ON s.lang IS NOT DISTINCT FROM c.lang AND s.lev = c.lev AND s.i = xor(c.i, 1)
      WHERE c.n > 1),
    climbed AS (
      SELECT doc_id, leaf, start, r.h AS subroot, 0 AS lev, r.i, r.n, proof, c.h
      FROM climb c JOIN roots r ON r.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1),
    upper_climb AS (
      SELECT doc_id, leaf, start, subroot, lev, i, n, proof, h FROM climbed
      UNION ALL
      SELECT doc_id, leaf, start, subroot, c.lev + 1, c.i // 2, (c.n + 1) // 2,
        proof || coalesce(s.h, ''),
        sha256(CASE WHEN c.i % 2 = 1 THEN coalesce(s.h, '') || c.h ELSE c.h || coalesce(s.h, '') END)
      FROM upper_climb c LEFT JOIN top s ON s.lev = c.lev AND s.i = xor(c.i, 1)
      WHERE c.n > 1)
    SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256,
      c.h AS folded_root, c.h = t.h AS verified
    FROM upper_climb c, (SELECT h FROM top WHERE n = 1) t WHERE c.n = 1
    """,
)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_digest(table(spark, sf_dir, "documents"))


def merkle_digest(docs: DataFrame) -> DataFrame:
    """Proofs of the documents, and what they make of rows where n_chars is tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    hashed = docs.select(
        "doc_id", "lang",
        merkle.leaf_hash("doc_id", "source", "lang", "n_chars", "text").alias("leaf"),
        F.when(
            tampered,
            merkle.leaf_hash("doc_id", "source", "lang", F.col("n_chars") + 1, "text"),
        ).alias("tampered"),
    )
    built = merkle.manifest(hashed, "leaf", "lang", "doc_id", carried=["doc_id", "tampered"])
    shown = F.coalesce("carried.tampered", "leaf")
    folded = built.leaves.withColumn("folded_root", merkle.fold(shown, F.col("path")))
    return folded.select(
        "carried.doc_id", "leaf", "subroot", "root",
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def rebuilt_conversations(rows: DataFrame, every: int = 20, starts: int = 4) -> DataFrame:
    """(conv_id, turns): each conversation c begins with the first crc32(c) mod `starts` turns
    of conversation c - c % `every`, where its own first ones stood."""
    lists = materialize(prefix_trie.turn_lists(rows), "turn-lists")
    conv = F.col("conv_id")
    first = lists.filter(conv % every == 0).select(
        conv.alias("base"), F.slice("turns", 1, starts - 1).alias("start")
    )
    none = F.expr("cast(array() as array<string>)")
    length = (F.crc32(conv.cast("string")) % starts).cast("int")
    return (
        lists.withColumn("base", conv - conv % every)
        .join(first, "base", "left")
        .select(
            "conv_id",
            F.concat(
                F.slice(F.coalesce("start", none), F.lit(1), length),
                F.slice("turns", length + 1, F.size("turns")),
            ).alias("turns"),
        )
    )


@register(
    "op12_prefix_trie",
    rf"""
    WITH RECURSIVE {_CRC_TABLE},
    own AS (
      SELECT conv_id, {_CRC("conv_id")} % 4 AS h, conv_id - conv_id % 20 AS base, turns
      FROM crc_table, (
        SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
          ORDER BY turn NULLS FIRST,
            substr(sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)
          ) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)),
    rebuilt AS (
      SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns
      FROM own o LEFT JOIN own b ON b.conv_id = o.base),
    prefixes AS (
      SELECT conv_id, d, len(turns) AS n, turns[1:d] AS path
      FROM rebuilt, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
    nodes AS (
      SELECT d, path, min(conv_id) AS conv_id, count(*) AS n,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends
      FROM prefixes GROUP BY d, path),
    tree AS (
      SELECT c.*, p.conv_id AS parent, (SELECT count(*) FROM nodes k WHERE k.d = c.d + 1
          AND k.path[1:c.d] = c.path) AS kids,
        CASE WHEN c.d = 0 THEN 0 ELSE
          (c.n - 1) * len(regexp_extract_all(c.path[c.d].text, '[^ 	-
]+')) END AS saved
      FROM nodes c LEFT JOIN nodes p ON p.d = c.d - 1 AND p.path = c.path[1:c.d - 1]),
    spread AS (
      SELECT unnest(range(0, d + 1)) AS top, path, kids, saved FROM tree),
    sums AS (
      SELECT top, path[1:top] AS path, count(*) FILTER (kids = 0) AS leaves, sum(saved) AS saved
      FROM spread GROUP BY 1, 2)
    SELECT t.conv_id, t.d AS depth, t.parent AS parent_conv_id, t.n AS n_convs, t.kids AS n_children,
      s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(t.ends) AS ends_sha256
    FROM tree t JOIN sums s ON s.top = t.d AND s.path = t.path
    """,
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.prefix_trie(rebuilt_conversations(table(spark, sf_dir, "conversations")))
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "ends_sha256",
    )


@register("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), word_tokenizer())
