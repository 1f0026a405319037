"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volley.llm import bpe, decontamination, divergence, exact_dedup, infilling, langid, minhash, mixing, pii, suffix_tree, toxicity, warc, webp
from volley.llm.shared import fold, scratch_root, table

TOKENIZER = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def domains_of(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", mixing.label_domain(F.col("quality"), F.col("toxic")).alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return mixing.mix(docs, domains_of(labels), mixing.TARGETS).drop("key", "m")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85).drop("key", "first")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold(F.col("doc_id"), 4) != 2)
    return langid.detect(docs.select("doc_id", "text"), model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, vocabulary_path(), with_ids=False, with_text=False).drop("text")


def op6_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return webp.store_texts(docs, with_media=False).drop("text")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_tree.score_documents(docs, fold(F.col("doc_id"), 7) != 2)
    return out.withColumn("held_out", fold(F.col("doc_id"), 7) == 2)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    last = warc.read_warc(spark, path, with_data=False).filter("last")
    revisit = F.col("record_type") == "revisit"
    return last.select(
        F.col("record_id").cast("long").alias("page_id"),
        F.when(revisit, F.col("header_length")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("header_digest")).otherwise(F.col("sha1_so_far")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.score_texts(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_benchmark(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), with_text=False)
    return decontamination.digest(found)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digest(infilling.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_pii": op2_pii,
    "op4_minhash": op4_minhash,
    "op3_language_id": op3_language_id,
    "op5_bpe": op5_bpe,
    "op6_webp": op6_webp,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_decontamination": op11_decontamination,
    "op12_source_divergence": op12_source_divergence,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op8_exact_dedup": f"""
        with d as (select doc_id, {_LOWER} as t from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from d join g using (t)""",
    "op9_warc": """
        with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        g as (select h, max(page_id) as keep_id from p group by h)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id <> keep_id then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id <> keep_id then keep_id end as refers_to
        from p join g using (h)""",
    "op11_decontamination": rf"""
        with d as (select doc_id, row_number() over () as r, regexp_extract_all({_LOWER}, '{decontamination.WORD}') as w from documents),
        i as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '{decontamination.WORD}') as w from benchmark),
        windows as (select distinct item, w[p : p + least(len(w), 10) - 1] as x
                    from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from i where len(w) > 0)),
        sizes as (select distinct len(x) as k from windows),
        places as (select r, k, w[p : p + k - 1] as x, p
                   from (select r, w, k, unnest(range(1, len(w) - k + 2)) as p from d, sizes where len(w) >= k)),
        found as (select r, p, k, item from places join windows using (x)),
        hit as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + k)) as q from (select distinct r, p, k from found)) group by r),
        items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct r, item from found) group by r)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (r) left join items using (r)""",
    "op12_source_divergence": rf"""
        with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                          regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
        words as (select r, lang, source, unnest(w) as term from d),
        kept as (select lang, term from words group by all having count(distinct r) >= 10),
        counts as (select lang, source, term, count(*) as c from words join kept using (lang, term) group by all),
        v as (select lang, count(*) as v from kept group by all),
        g as (select distinct lang, source from d),
        n as (select lang, source, sum(c) as n from counts group by all),
        grid as (select g.lang, g.source, k.term, coalesce(c, 0) as c,
                        cast(1 + 1000000000::hugeint * (coalesce(c, 0) + 2) // (coalesce(n, 0) + 2 * v) as hugeint) as p
                 from g join kept k using (lang) join v using (lang) left join n using (lang, source) left join counts using (lang, source, term)),
        whole as (select lang, term, cast(1 + 1000000000::hugeint * (sum(c) + 2) // (sum(sum(c)) over (partition by lang) + 2 * any_value(v)) as hugeint) as q
                  from counts join v using (lang) group by lang, term),
        pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
                  from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
        all_pairs as (select g.lang, g.source, h.source as item, cast(coalesce(value, 0) as bigint) as value
                      from g join g h on g.lang = h.lang and g.source <> h.source
                      left join pairs on pairs.lang = g.lang and pairs.source = g.source and pairs.item = h.source),
        terms as (select lang, source, term as item, cast((p - q) * (p - q) // (p + q) as bigint) as value
                  from grid join whole using (lang, term) where c > 0 and p > q),
        ranked as (select lang, source, 'pair' as part, item, value from all_pairs union all select lang, source, 'term', item, value from terms)
        select * from (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from ranked)
        where part = 'pair' or rank <= 10""",
    "op13_fill_in_middle": r"""
        with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w,
                          sha256('42:' || doc_id) as h from documents),
        e as (select doc_id, t, w, len(w) as n, [cast('0x' || h[8 * k + 1 : 8 * k + 8] as bigint) for k in range(4)] as h from d),
        f as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
                     case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 50 then 'plain'
                          when h[4] % 100 < 80 then 'spm' else 'psm' end as form from e),
        x as (select *, array_to_string(w[1 : a], '') as p, array_to_string(w[a + 1 : b], '') as m, array_to_string(w[b + 1 : n], '') as s from f)
        select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
               sha256(t) as restored_sha256
        from x""",
}
