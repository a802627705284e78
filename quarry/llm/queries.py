"""Registered queries over these operators, each on its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import toxicity

    docs = _documents(spark, sf_dir)
    model = toxicity.fit_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import mixing

    mix, rows = mixing.fit_mix(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    posteriors = [F.get("p", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(mix.model.names)]
    return mixing.rates(rows, mix).select("doc_id", "tokens", *posteriors, "rate", "copies")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import bpe

    d = bpe.decode(bpe.encode(_documents(spark, sf_dir)))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import imatch

    return imatch.fingerprints(_documents(spark, sf_dir))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import neardup

    return neardup.classes(_documents(spark, sf_dir))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import lmscore

    docs = _documents(spark, sf_dir)
    wanted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and coalesce(toxic, 0) = 0")
    return lmscore.score(docs, wanted)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import tokens

    return tokens.write_and_read(_documents(spark, sf_dir))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import suffix

    d = suffix.deduplicate(_documents(spark, sf_dir))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import shards
    from quarry.llm.common import scratch

    store = shards.ingest(_documents(spark, sf_dir), scratch(spark, "store"), 8)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import media

    f = media.fingerprint(media.to_wav(_documents(spark, sf_dir)))
    return f.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -media.BLOCK, media.BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.sha2(F.array_join(F.col("pairs").cast("array<string>"), " ").cast("binary"), 256).alias("feature"),
        F.size("pairs").cast("long").alias("n_pairs"),
    )


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import resample

    return resample.resample(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import phrases

    return phrases.collocations(_documents(spark, sf_dir))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import lines
    from quarry.llm.common import scratch

    kept = lines.deduplicate(_documents(spark, sf_dir), scratch(spark, "lines"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_bpe, op4_imatch, op5_minhash, op6_lm_scoring, op7_token_files, op8_suffix_array, op9_sharding, op10_media, op11_resample, op12_phrases, op13_lines)}

ORACLES: dict[str, str] = {
    # every pair that shares a shingle, and the closure of the links
    "op5_minhash": """
        with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as t from documents),
        d as (select distinct doc_id, unnest(case when len(t) = 0 then [] when len(t) < 5 then [array_to_string(t, ' ')] else list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) end) as s from w),
        n as (select doc_id, count(*) as n from d group by 1),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as c from d a join d b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
        l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
        e as (select a, b from l union select b, a from l),
        r(node, seen) as (select doc_id, doc_id from documents union select r.node, e.b from r join e on e.a = r.seen),
        c as (select node as doc_id, min(seen) as component_id from r group by 1)
        select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from c left join n using (doc_id)""",
    # every string of 100 bytes with its first place, as hexadecimal text
    "op8_suffix_array": """
        with w as (select doc_id, hex(encode(coalesce(text, ''))) as h, length(hex(encode(coalesce(text, '')))) // 2 as n from documents),
        s as (select doc_id, i, substr(h, 2 * i + 1, 200) as g from (select doc_id, h, unnest(range(0, greatest(n - 99, 0))) as i from w)),
        r as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from s) where k > 1),
        m as (select doc_id, i, max(i + 100) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before from r),
        k as (select doc_id, i, sum(case when before is null or i > before then 1 else 0 end) over (partition by doc_id order by i) as k from m),
        c as (select doc_id, k, min(i) as a, max(i) + 100 as b from k group by 1, 2),
        g as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as x, a as y from c
              union all select doc_id, coalesce(b, 0), n from w left join (select doc_id, max(b) as b from c group by 1) using (doc_id)),
        t as (select doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' order by x) as kept from g join w using (doc_id) where y > x group by 1),
        q as (select doc_id, sum(b - a) as removed, count(*) as spans from c group by 1)
        select doc_id, n::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from w left join t using (doc_id) left join q using (doc_id)""",
    "op9_sharding": "select doc_id, lang, source, n_chars, strlen(text) as n_bytes, sha256(text) as text_sha256 from documents",
    # CRC-32 by its table, over the bytes of each distinct word
    "op11_resample": """
        with steps(i, v, k) as (select i::bigint, i::bigint, 0 from range(256) t(i)),
        t1 as (select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end as v from steps), t2 as (select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end as v from t1),
        t3 as (select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end as v from t2), t4 as (select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end as v from t3),
        t5 as (select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end as v from t4), t6 as (select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end as v from t5),
        t7 as (select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end as v from t6), t8 as (select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end as v from t7),
        tbl as (select list(v order by i) as tbl from t8),
        w as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from documents),
        v as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
        d as (select word, hex(encode(word)) as h from (select word from w union select word from v)),
        b as (select word, list_transform(range(0, length(h) // 2), lambda i: ((instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)::bigint) as bytes from d),
        c as (select word, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295::bigint) % 10000 as bucket from b, tbl),
        s as (select bucket, count(*) as s from w join c using (word) group by 1), t as (select bucket, count(*) as t from v join c using (word) group by 1),
        g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from w) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((select count(*) from v) + 10000)::double)))::bigint as gain from s left join t using (bucket)),
        m as (select doc_id, count(*) as n, sum(gain) as total from w join c using (word) join g using (bucket) group by 1),
        x as (select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(floor(total::double / n), 0)::bigint as weight, sha256('2024:' || doc_id) as h from documents left join m using (doc_id)),
        y as (select doc_id, n_features, weight, list_reduce(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(h, i, 1)) - 1)::bigint), lambda a, q: a * 16 + q) as h from x),
        z as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from y),
        r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from z where n_features >= 20)
        select z.doc_id, n_features, weight, score, rank from z left join r on r.doc_id = z.doc_id and rank <= (select count(*) from r) * 10 // 100""",
    "op12_phrases": """
        with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) as piece from documents),
        w as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as w from p),
        g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*)::hugeint as f from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, range(1, 5) t(k)) group by all),
        n as (select lang, sum(f)::bigint as n from g where k = 1 group by 1),
        c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from g where k > 1 and f >= 30),
        u as (select lang, k, phrase, a, c, array_to_string(w[1:c], ' ') as x, array_to_string(w[c + 1:], ' ') as y from (select *, unnest(range(1, k)) as c from c)),
        s as (select u.lang, u.k, u.phrase, a, c, x.f as l, y.f as r, 2000000 * a // (x.f + y.f) as score from u join g x on x.lang = u.lang and x.phrase = u.x join g y on y.lang = u.lang and y.phrase = u.y),
        b as (select * from s qualify row_number() over (partition by lang, phrase order by score, c) = 1),
        i as (select lang, a, array_to_string(w[i:i + m - 1], ' ') as phrase from (select *, unnest(range(1, k - m + 2)) as i from c, range(2, 4) t(m) where m < k)),
        o as (select distinct b.lang, b.phrase from b join i on i.lang = b.lang and i.phrase = b.phrase and 100 * i.a >= 80 * b.a),
        e as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b anti join o using (lang, phrase))
        select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from e join n using (lang) where rank <= 2000""",
    "op13_lines": """
        with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents),
        r as (select doc_id, unnest(x) as line, unnest(range(len(x))) as i from s),
        k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from r),
        f as (select key, min(doc_id) as lo from k where length(key) >= 10 group by key having min(doc_id) < max(doc_id)),
        g as (select doc_id, i, line, lo is not null and doc_id > lo as gone from k left join f using (key))
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from g group by 1""",
}
