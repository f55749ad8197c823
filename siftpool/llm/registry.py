"""The queries of the numbered operators: whole tables, production parameters, the digest columns of each contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftpool.llm.substring import repeats_digest

    return repeats_digest(_table(spark, sf_dir, "documents"), window=35)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftpool.llm.chat import conversation_digest

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return conversation_digest(_table(spark, sf_dir, "conversations").select(more.columns).unionByName(more))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftpool.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftpool.llm.toxicity import fit_toxicity, held_out, with_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    return with_toxicity(docs, model, spans="spans").select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftpool.llm.packing import packed_ids

    return packed_ids(_table(spark, sf_dir, "documents"), vocabulary(), size=1024)


def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftpool.llm.packing import retrieval_packed

    return retrieval_packed(_table(spark, sf_dir, "documents"), vocabulary(), size=1024)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftpool.llm.fingerprint import fingerprint_edits

    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftpool.llm.decontaminate import contained_items

    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftpool.llm.language import fit_language, with_language
    from siftpool.llm.toxicity import held_out

    docs = _table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit_language(docs, ~out)
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftpool.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftpool.llm.clustering import clustered

    return clustered(_table(spark, sf_dir, "embeddings"), k=16, rounds=3)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftpool.llm.quality import fit_quality, with_quality

    docs = _table(spark, sf_dir, "documents")
    rules = fit_quality(docs, _table(spark, sf_dir, "labels"))
    return with_quality(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op13_repaired_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftpool.llm.repair import damaged, repaired

    rows = _table(spark, sf_dir, "conversations")
    return repaired(damaged(rows), every=rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

_SQL = {
    "op1_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format('text')} ws FROM documents),
        win AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) s, unnest([array_to_string(ws[i:i + 34], ' ') for i in range(1, len(ws) - 33)]) g FROM w WHERE len(ws) >= 35),
        again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, s + k pos, true AS hit FROM win SEMI JOIN again USING (g), range(0, 35) t(k)),
        own AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) pos, unnest(ws) word FROM w),
        told AS (SELECT own.*, gone.hit FROM own LEFT JOIN gone USING (doc_id, pos))
        SELECT w.doc_id, count(pos) n_words, count(hit) n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE hit IS NULL), '')) kept_sha256
        FROM w LEFT JOIN told USING (doc_id) GROUP BY w.doc_id""",
    "op2_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS "role", coalesce(text, '') t FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, "role" || chr(0) || t x FROM c),
        n AS (SELECT *, length(x) - 1 + length(x) - length(replace(x, '\', '')) + list_sum([(length(x) - length(replace(x, k, ''))) // length(k) for k in ['<s>', '</s>', '[INST]', '[/INST]']]) size FROM e)
        SELECT conv_id, count(*) n_turns, sha256(string_agg("role" || chr(10) || t || chr(10), '' ORDER BY turn, "role", t)) turns_sha256,
            coalesce(sum(length(t)) FILTER (WHERE "role" = 'assistant'), 0)::BIGINT loss_chars,
            sha256(coalesce(string_agg(t, '' ORDER BY turn, "role", t) FILTER (WHERE "role" = 'assistant'), '')) loss_sha256,
            sum(size + length('<s>[INST] ') + length(' [/INST]') + length('</s>') + 1)::BIGINT formatted_chars
        FROM n GROUP BY conv_id""",
    "op8_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') ws FROM benchmark),
        q AS (SELECT *, least(5, len(ws)) k FROM b WHERE len(ws) > 0),
        qg AS (SELECT DISTINCT item_id, k, unnest([array_to_string(ws[i:i + k - 1], ' ') for i in range(1, len(ws) - k + 2)]) g FROM q),
        dg AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(ws[i:i + k - 1], ' ') for i in range(1, len(ws) - k + 2)]) g FROM d, (SELECT DISTINCT k FROM q) WHERE len(ws) >= k),
        n AS (SELECT item_id, count(*) n_shingles FROM qg GROUP BY ALL),
        f AS (SELECT doc_id, item_id, count(*) n_found FROM qg JOIN dg USING (k, g) GROUP BY ALL)
        SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles containment FROM f JOIN n USING (item_id) WHERE 10 * n_found >= 8 * n_shingles""",
    "op11_ball_tree_clusters": "WITH "
    + """v AS MATERIALIZED (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] x FROM embeddings
            WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < 16),"""
    + ",".join(
        f"""
        a{i} AS MATERIALIZED (SELECT vec_id, v.x, min(struct_pack(d := list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.x, c{i}.x)])::BIGINT, c := c)) m FROM v, c{i} GROUP BY vec_id, v.x),
        s{i} AS (SELECT m.c c, k, sum(x[k]) s, count(*) n FROM a{i}, range(1, 65) t(k) GROUP BY m.c, k),
        c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(y, x) x FROM c{i} LEFT JOIN (SELECT c, list((s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END)::BIGINT ORDER BY k) y FROM s{i} GROUP BY c) USING (c))"""
        for i in range(3)
    )
    + """,
        f AS MATERIALIZED (SELECT vec_id, min(struct_pack(d := list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.x, c3.x)])::BIGINT, c := c)) m FROM v, c3 GROUP BY vec_id, v.x)
        SELECT vec_id, m.c::INTEGER "cluster", m.d distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT cluster_inertia, sum(m.d) OVER ()::BIGINT inertia, sha256(array_to_string(c3.x, ',')) centroid_sha256
        FROM f JOIN c3 ON c3.c = f.m.c""",
    "op13_repaired_turns": r"""
        WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce("role", ' ') r, coalesce(text, ' ') t,
                list_reduce(list_prepend(4294967295::BIGINT, flatten([[(ascii(ch) >> k) & 1 for k in range(0, 8)] for ch in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')])),
                    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))) low FROM conversations),
        hit AS (SELECT *, xor(low, 4294967295) % 20 kind FROM raw),
        rows_ AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE r END r, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END t, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) copy FROM hit WHERE kind <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t, copy) n, rtrim(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) bare,
            CASE WHEN r[1] IN ('s', 'u', 'a') THEN r[1] ELSE '-' END init FROM rows_),
        f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, r, t ORDER BY n) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END fault,
            lag(init) OVER (PARTITION BY conv_id ORDER BY n) prev FROM o),
        edge AS (FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(a, c, b)),
        jump AS (SELECT a, a b, 0 cost, '' edits FROM (VALUES (0), (1), (2), (3)) v(a) UNION ALL SELECT a, b, 5, 'I' FROM edge WHERE c <> 's' UNION ALL VALUES (0, 3, 10, 'II'), (1, 3, 10, 'II')),
        move AS (SELECT x.a, x.b, i.c, w.price, w.edit FROM edge x, (VALUES ('K', 0), ('R', 1)) w(edit, price), (VALUES ('s'), ('u'), ('a'), ('-')) i(c) WHERE w.edit = 'K' AND x.c = i.c OR w.edit = 'R' AND x.c <> 's'),
        deed AS (SELECT a, b, c, price, edit FROM move UNION ALL SELECT v.a, v.a, i.c, 2, 'D' FROM (VALUES (0), (1), (2), (3)) v(a), (VALUES ('s'), ('u'), ('a'), ('-')) i(c)),
        size AS (SELECT conv_id, max(n) n FROM f GROUP BY 1),
        dp AS (SELECT conv_id, 0::BIGINT n, 0 st, 0 cost, '' audit FROM size
            UNION ALL SELECT conv_id, n, st, best.c, best.a FROM (SELECT dp.conv_id, f.n, d.b st, min(struct_pack(c := dp.cost + j.cost + d.price + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 5 ELSE 0 END, a := dp.audit || j.edits || d.edit)) best
                FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.n = dp.n + 1 JOIN jump j ON j.a = dp.st JOIN deed d ON d.a = j.b AND d.c = f.init WHERE d.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate') GROUP BY ALL)),
        fin AS (SELECT dp.conv_id, min(struct_pack(c := cost + CASE st WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, a := audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END)) e FROM dp JOIN size s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.n = dp.n GROUP BY 1),
        ed AS (SELECT conv_id, generate_subscripts(string_split(e.a, ''), 1) k, unnest(string_split(e.a, '')) x, e.a a FROM fin WHERE e.a <> ''),
        at_ AS (SELECT *, count(*) FILTER (WHERE x <> 'I') OVER w n, count(*) FILTER (WHERE x <> 'D') OVER w - (length(replace(a, 'D', '')) % 2) j FROM ed WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
        line AS (SELECT at_.conv_id, k, CASE WHEN x = 'K' THEN f.r WHEN j % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE f.t END l FROM at_ LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM at_.conv_id AND f.n = at_.n WHERE x <> 'D'),
        sha AS (SELECT conv_id, sha256(string_agg(l, chr(10) ORDER BY k)) h FROM line GROUP BY 1),
        fact AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (WHERE fault = 'blank') blank, count(*) FILTER (WHERE fault = 'duplicate') duplicate, count(*) FILTER (WHERE fault = 'truncated') truncated,
            count(*) FILTER (WHERE prev IS NOT NULL AND prev || init NOT IN ('su', 'ua', 'au')) illegal FROM f GROUP BY 1)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT gaps, coalesce(blank, 0)::BIGINT blank, coalesce(duplicate, 0)::BIGINT duplicate, coalesce(truncated, 0)::BIGINT truncated, coalesce(illegal, 0)::BIGINT illegal,
            coalesce(e.c, 0)::BIGINT AS "cost", coalesce(e.a, '') audit, coalesce(h, sha256('')) repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN fact ON fact.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN sha ON sha.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op10_near_duplicates": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN [array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) g FROM w),
        n AS (SELECT w.doc_id, count(g) n FROM w LEFT JOIN s USING (doc_id) GROUP BY ALL),
        p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id z FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.z)
        SELECT doc_id, any_value(n) n_shingles, min(z) component_id, doc_id = min(z) kept FROM r JOIN n USING (doc_id) GROUP BY doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
