"""The registered queries of the llm operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlark.llm import conversations, kneser_ney, phrases, warc
from paperlark.llm.bpe import bpe_round_trip
from paperlark.llm.common import crc_fold, table
from paperlark.llm.minhash import near_duplicates
from paperlark.llm.packing import pack
from paperlark.llm.png_media import media_table
from paperlark.llm.qda import fit_quality, score_quality
from paperlark.llm.sharding import minimax_shards
from paperlark.llm.token_counts import token_counts
from paperlark.llm.toxicity import fit_toxicity, score_toxicity
from paperlark.llm.voronoi import top_products


def op9_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen shards of documents with nearly equal bytes; equal texts stay together."""
    out = minimax_shards(table(spark, folder, "documents").select("doc_id", "text"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _judged(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op1_quality_qda(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality; rows whose id's crc32 is divisible by 5 are held out of the fit."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, folder, "labels").where(crc_fold("doc_id") != 0))
    return _judged(score_quality(docs, model), 0.3)


def op2_png_media(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a PNG, read back and hashed."""
    found = media_table(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "hash", "error")


def op3_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's probability; rows whose id's crc32 leaves 1 modulo 5 are held out of the counts."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = kneser_ney.fit(docs.where(crc_fold("doc_id") != 1))
    return kneser_ney.score(docs, model).select("doc_id", (crc_fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_voronoi_top_products(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest products of every hundredth vector with all others."""
    return top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op5_concatenate_and_cut(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=2048, cached=750_000)


def op6_minhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_duplicates(table(spark, folder, "documents"))


def op7_toxicity_nbsvm(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity; rows whose id's crc32 is divisible by 5 are held out of the fit."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, folder, "labels").where(crc_fold("doc_id") != 0))
    return _judged(score_toxicity(docs, model), 0.5)


def op8_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded with the word BPE vocabulary and decoded again."""
    return bpe_round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's number of tokens of the piece vocabulary."""
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a record of web archives, read back chunk by chunk."""
    archives = warc.archives_of(spark, warc.write_archives(table(spark, folder, "pages")))
    return warc.page_records(warc.read_chunks(archives, with_bytes=False))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 phrases of each language that hold together best."""
    found, totals = phrases.count_phrases(table(spark, folder, "documents"), least=30)
    return phrases.collocations(found, totals, top=2000)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation damaged and repaired at the least cost."""
    return conversations.repair(conversations.damage(table(spark, folder, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_qda": op1_quality_qda,
    "op2_png_media": op2_png_media,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_voronoi_top_products": op4_voronoi_top_products,
    "op5_concatenate_and_cut": op5_concatenate_and_cut,
    "op6_minhash_near_duplicates": op6_minhash_near_duplicates,
    "op7_toxicity_nbsvm": op7_toxicity_nbsvm,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_minimax_shards": op9_minimax_shards,
    "op10_token_counts": op10_token_counts,
    "op11_warc_chunks": op11_warc_chunks,
    "op12_collocations": op12_collocations,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op6_minhash_near_duplicates": r"""
        with recursive w as (
            select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
        ), s as (
            select doc_id, case when w is null or len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
            from w
        ), e as (select doc_id, unnest(s) as x from s
        ), p as (
            select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2
        ), l as (
            select a, b from p join s x on a = x.doc_id join s y on b = y.doc_id where 100 * c >= 85 * (len(x.s) + len(y.s) - c)
        ), ways as (select a, b from l union all select b, a from l
        ), reach(doc_id, r) as (
            select doc_id, doc_id from s union select reach.doc_id, b from reach join ways on r = a
        )
        select doc_id, cast(len(s) as bigint) as n_shingles, min(r) as component_id, min(r) = doc_id as kept
        from s join reach using (doc_id) group by doc_id, s""",
    "op4_voronoi_top_products": """
        with v as (
            select distinct vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, v.vec_id,
                cast(coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda t: t[1] * t[2])), 0) as bigint) as score
            from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0
        )
        select query_id, cast(rank as integer) as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        where rank <= 10""",
    "op11_warc_chunks": r"""
        with p as (
            select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as s, min(page_id) over (partition by coalesce(html, '')) as f from pages
        )
        select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes,
            array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
                lambda b: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((cast('0x' || s[5 * i + 1:5 * i + 5] as bigint) >> b) & 31)]), '')), '') as payload_digest,
            case when page_id = f then 'response' else 'revisit' end as record_type, case when page_id <> f then f end as refers_to, cast(null as varchar) as error
        from p""",
    "op12_collocations": r"""
        with p as (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
            from documents
        ), w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from p
        ), g as (
            select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase
            from w, (select unnest([1, 2, 3, 4]) as m) where len(w) >= m
        ), f as (select lang, m, phrase, count(*) as f from g group by all
        ), n as (select lang, cast(sum(f) as bigint) as n from f where m = 1 group by lang
        ), c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from f where m > 1 and f >= 30
        ), longer as (
            select lang, array_to_string(w[s:s + z - 1], ' ') as phrase, max(a) as most
            from (select *, unnest(range(1, m - z + 2)) as s from (select *, unnest(range(2, m)) as z from c where m > 2)) group by all
        ), cuts as (
            select c.lang, c.phrase, a, k, l.f as l, r.f as r, cast((2000000 :: hugeint * a) // (l.f + r.f) as bigint) as score
            from (select *, unnest(range(1, m)) as k from c) c
            join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:k], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:c.m], ' ')
            left join longer o on o.lang = c.lang and o.phrase = c.phrase where most is null or 100 * most < 80 * a
        ), worst as (
            select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
        )
        select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score
        from worst join n using (lang) qualify rank <= 2000""",
    "op13_conversation_repair": r"""
        with recursive table_of as (
            select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
        ), c as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                xor(list_reduce([4294967295] || list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint)),
                    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 as kind
            from conversations, table_of
        ), damaged as (
            select conv_id, turn, case kind when 4 then 'user' else role end as role,
                case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
            from (select * from c union all select * from c where kind = 3) where kind <> 0
        ), placed as (
            select *, row_number() over (partition by conv_id order by turn nulls first, role, text, again) as i, count(*) over (partition by conv_id) as n,
                regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) as last, role[1:1] as ini
            from (select *, row_number() over (partition by conv_id, role, text order by turn nulls first) > 1 as again from damaged)
        ), b as (
            select *, case when last = '' then 1 when again then 2 when last not in ('.', '!', '?') then 3 else 0 end as fault,
                lag(ini) over (partition by conv_id order by i) as before
            from placed
        ), v as (
            select conv_id, n + 1 as i, 0 as e, 4 as s, 2 as u, 0 as a from b where i = n
            union all
            select conv_id, i, least(oe, 2 + least(ou, 2 + oa)), least(os, 2 + least(ou, 2 + oa)), least(ou, 2 + oa), least(oa, 2 + ou) from (
                select b.conv_id, b.i,
                    case when fault in (1, 2) then 3 + e else least(3 + e, m + 2 + u, case ini when 's' then m + s when 'u' then m + u else 999999 end) end as oe,
                    case when fault in (1, 2) then 3 + s else least(3 + s, m + 2 + u, case ini when 'u' then m + u else 999999 end) end as os,
                    case when fault in (1, 2) then 3 + u else least(3 + u, m + 2 + a, case ini when 'a' then m + a else 999999 end) end as ou,
                    case when fault in (1, 2) then 3 + a else least(3 + a, m + 2 + u, case ini when 'u' then m + u else 999999 end) end as oa
                from v join (select *, case fault when 3 then 1 else 0 end as m from b) b on b.conv_id is not distinct from v.conv_id and b.i = v.i - 1
            )
        ), steps as (
            select b.conv_id, b.i, b.role, b.text, b.ini, b.fault not in (1, 2) as stays, case fault when 3 then 1 else 0 end as m,
                {'e': v.e, 's': v.s, 'u': v.u, 'a': v.a} as h, {'e': x.e, 's': x.s, 'u': x.u, 'a': x.a} as x
            from b join v on v.conv_id is not distinct from b.conv_id and v.i = b.i join v x on x.conv_id is not distinct from b.conv_id and x.i = b.i + 1
            union all
            select conv_id, n + 1, null, null, null, false, 0, {'e': 0, 's': 4, 'u': 2, 'a': 0}, {'e': 999999, 's': 999999, 'u': 999999, 'a': 999999} from b where i = n
        ), walk as (
            select conv_id, 1 as i, 'e' as q, '' as audit, [] :: varchar[] as done from b where i = 1
            union all
            select conv_id, i + (edit <> 'I') :: int,
                case edit when 'D' then q when 'K' then ini else f end, audit || edit,
                case edit when 'D' then done when 'I' then done || [case f when 'u' then 'user:' else 'assistant:' end]
                    when 'K' then done || [role || ':' || text] else done || [case f when 'u' then 'user:' else 'assistant:' end || text] end
            from (
                select w.*, s.role, s.text, s.ini, case q when 'u' then 'a' else 'u' end as f,
                    case when 3 + case q when 'e' then x.e when 's' then x.s when 'u' then x.u else x.a end = case q when 'e' then h.e when 's' then h.s when 'u' then h.u else h.a end then 'D'
                        when 2 + case q when 'u' then h.a else h.u end = case q when 'e' then h.e when 's' then h.s when 'u' then h.u else h.a end then 'I'
                        when stays and (ini = 's' and q = 'e' or ini = 'u' and q in ('e', 's', 'a') or ini = 'a' and q = 'u') and m + case ini when 'e' then x.e when 's' then x.s when 'u' then x.u else x.a end = case q when 'e' then h.e when 's' then h.s when 'u' then h.u else h.a end then 'K'
                        when stays and m + 2 + case q when 'u' then x.a else x.u end = case q when 'e' then h.e when 's' then h.s when 'u' then h.u else h.a end then 'R' end as edit
                from walk w join steps s on s.conv_id is not distinct from w.conv_id and s.i = w.i
            ) where edit is not null
        ), told as (
            select conv_id, case when count(turn) = 0 then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end as gaps,
                count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
                count(*) filter (before is not null and before || ini not in ('su', 'ua', 'au')) as illegal
            from b group by conv_id
        ), last as (
            select conv_id, arg_max(audit, len(audit)) as audit, arg_max(done, len(audit)) as done from walk group by conv_id
        )
        select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
            coalesce(illegal, 0) as illegal, cast(coalesce(v.e, 0) as bigint) as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(done, chr(10)), '')) as repaired_sha256
        from (select distinct conv_id from conversations) o left join told on told.conv_id is not distinct from o.conv_id
            left join last on last.conv_id is not distinct from o.conv_id left join v on v.conv_id is not distinct from o.conv_id and v.i = 1""",
}
