"""The registered queries of this package, each with its SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bondwise.llm import text as text_rules
from bondwise.llm import decontaminate, disclosure, forest, html_crf, language, licenses, lines, packing, simhash, spelling, token_rollup, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ASCII_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    f"""
    with d as (select doc_id, {WORDS.format(ASCII_LOW.format("coalesce(text, '')"))} w from documents),
    b as (select item_id, {WORDS.format(ASCII_LOW.format("coalesce(text, '')"))} w from benchmark),
    win as (
        select item_id, least(len(w), 10) k, unnest(range(0, len(w) - least(len(w), 10) + 1)) i, w from b where len(w) > 0
    ),
    keys as (select distinct item_id, k, array_to_string(w[i + 1:i + k], ' ') key from win),
    sizes as (select distinct k from keys),
    pos as (select doc_id, w, k, unnest(range(0, len(w) - k + 1)) i from d, sizes where len(w) >= k),
    hit as (select doc_id, i, p.k, item_id from (select doc_id, i, k, array_to_string(w[i + 1:i + k], ' ') key from pos) p join keys using (key, k)),
    cover as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + k)) j from hit) group by doc_id),
    own as (select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids from (select distinct doc_id, item_id::varchar id from hit) group by doc_id)
    select d.doc_id, len(d.w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
        sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
    from d left join cover using (doc_id) left join own using (doc_id)
    """
)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a window of ten benchmark words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))).drop("hit_spans")


def vocabulary() -> packing.Vocabulary:
    import public_tokenizers as public

    return packing.Vocabulary.of_files(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


@query()
def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


@query()
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; two thirds of the labelled documents may teach."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    split = docs.withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.fit(split.filter("not held_out"))
    return language.predict(split.select("doc_id", "text", "held_out"), model).drop("text")


@query(
    f"""
    with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
    l as (select doc_id, unnest(ls) line, unnest(range(len(ls))) i from d),
    k as (select doc_id, line, i, {ASCII_LOW.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} key from l),
    f as (select key, true gone from (select distinct doc_id, key from k) where key <> '' group by key having count(*) >= 10)
    select doc_id, count(*)::bigint n_lines, count(gone)::bigint n_dropped,
        sha256(coalesce(string_agg(line, chr(10) order by i) filter (where gone is null), '')) kept_sha256
    from k left join f using (key) group by doc_id
    """
)
def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines that stand in ten documents or more."""
    kept = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those that differ in two bits at most."""
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query()
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


@query()
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_crf.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def crawl_records(pages: DataFrame) -> DataFrame:
    """Each page as the full response of one crawl and as revisits of other crawls, some with stale or missing validators."""
    date = F.concat(F.lit("day "), (F.col("page_id") % 30).cast("string"))
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    headers = lambda *pairs: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs]))
    response = pages.select(
        F.concat(F.lit("r"), "page_id").alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit(warc.RESPONSE).alias("kind"),
        headers(("etag", tag), ("last-modified", date), ("cache-control", F.lit("max-age=60")), ("content-length", F.octet_length("html").cast("string"))).alias("headers"),
    )
    asked = F.when(F.col("page_id") % 5 == 0, F.lit('"stale"')).when(F.col("page_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("W/"), tag))
    modified = F.when(F.col("page_id") % 6 != 0, date)
    revisit = pages.select(
        F.concat(F.lit("v"), "page_id").alias("record_id"), F.regexp_replace("url", r"^https?://(www\.)?", "HTTP://WWW.").alias("url"), (F.col("page_id") + 1_000_000_000).alias("ts"),
        F.lit(warc.REVISIT).alias("kind"), headers(("etag", asked), ("last-modified", modified), ("cache-control", F.lit("max-age=600")), ("content-length", F.lit("0"))).alias("headers"),
    )
    early = pages.filter("page_id % 7 = 0").select(
        F.concat(F.lit("e"), "page_id").alias("record_id"), "url", (F.col("page_id") - 1).alias("ts"), F.lit(warc.REVISIT).alias("kind"), headers(("etag", tag)).alias("headers")
    )
    return response.unionByName(revisit).unionByName(early)


@query(
    r"""
    with p as (
        select page_id, url, '"' || md5(html) || '"' as tag, 'day ' || (page_id % 30) as mod_day, strlen(html)::varchar size, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') bare
        from pages
    ),
    u as (
        select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') host,
            regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') path,
            array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' and not starts_with(x, 'utm_'))), '&') query
        from p
    ),
    c as (select *, host || path || case when query <> '' then '?' || query else '' end canonical_url from u),
    v as (
        select 'v' || page_id record_id, canonical_url, page_id + 1000000000 ts, case when page_id % 5 = 0 then '"stale"' when page_id % 3 = 0 then null else tag end as tag,
            case when page_id % 6 <> 0 then mod_day end as mod_day, true as late from c
        union all select 'e' || page_id, canonical_url, page_id - 1, tag, null, false from c where page_id % 7 = 0
    ),
    j as (
        select v.*, c.page_id full_id, c.tag full_tag, c.mod_day as full_day, c.size full_size,
            row_number() over (partition by v.record_id order by c.page_id desc nulls last, c.page_id::varchar desc) r
        from v left join c on c.canonical_url = v.canonical_url and (c.page_id < v.ts or (c.page_id = v.ts and 'r' || c.page_id < v.record_id))
    ),
    o as (
        select *, case when full_id is null then 'no earlier response' when tag is null and mod_day is null then 'no validator'
            when coalesce(case when tag is not null then tag = full_tag else mod_day = full_day end, false) then 'resolved' else 'validator mismatch' end outcome
        from j where r = 1
    )
    select record_id, canonical_url, case when outcome = 'resolved' then 'r' || full_id end refers_to, outcome,
        case when outcome <> 'resolved' then null else 'cache-control: ' || case when late then 'max-age=600' else 'max-age=60' end || chr(10) || 'content-length: ' || full_size || chr(10)
            || 'etag: ' || case when tag is null then full_tag when late then 'W/' || tag else tag end || chr(10) || 'last-modified: ' || full_day end headers
    from o
    """
)
def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits derived from every page, resolved to the full responses they confirm."""
    found = warc.resolve(crawl_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines_ = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.withColumn("headers", F.when(F.col("outcome") == "resolved", lines_))


def count_events(docs: DataFrame) -> DataFrame:
    """Counts of each document by two simple tokenizers, as inserts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = {"blank-1": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), "word-1": F.regexp_count(text, F.lit(text_rules.WORD_ANY_CASE))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("version"), v.cast("long").alias("tokens")) for k, v in counts.items()]))
    return docs.select("doc_id", "source", "lang", each.alias("c")).select("doc_id", "source", "lang", "c.*", F.lit(token_rollup.INSERT).alias("op"), F.lit(0).alias("seq"))


@query(
    rf"""
    with c as (
        select doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint b, len({WORDS.format(ASCII_LOW.format("coalesce(text, '')"))})::bigint w, n_chars from documents
    ),
    e as (select doc_id, source, lang, 'blank-1' as version, b tokens, n_chars from c union all select doc_id, source, lang, 'word-1', w, n_chars from c)
    select source, lang, version, count(*)::bigint docs, sum(tokens)::bigint tokens from (
        select case when doc_id % 7 = 0 then source || '-moved' else source end source, lang, version, case when doc_id % 7 = 0 then n_chars else tokens end tokens
        from e where not (doc_id % 11 = 0 and version = 'blank-1')
    ) group by all
    """
)
def op2_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents came in, every seventh was revised and every eleventh left one version; two batches are sent twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    rollup = token_rollup.TokenRollup.fresh(spark)
    first = count_events(docs)
    thin = docs.drop("text").withColumn("version", F.explode(F.array(F.lit("blank-1"), F.lit("word-1"))))
    moved = thin.filter("doc_id % 7 = 0").select(
        "doc_id", "version", F.concat("source", F.lit("-moved")).alias("source"), "lang", F.col("n_chars").alias("tokens"), F.lit(token_rollup.REVISE).alias("op"), F.lit(1).alias("seq")
    )
    gone = thin.filter("doc_id % 11 = 0 and version = 'blank-1'").select("doc_id", "version", "source", "lang", F.lit(0).alias("tokens"), F.lit(token_rollup.DELETE).alias("op"), F.lit(2).alias("seq"))
    for name, events in (("load", first), ("revise", moved), ("load", first), ("delete", gone), ("revise", moved)):
        rollup.commit(name, events)
    return rollup.totals()


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the sixteen leading components of the distinct ones, scaled to variance 1."""
    return whitening.whitened_table(table(spark, sf_dir, "embeddings"))


@query(
    r"""
    with steps as (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) v from (select unnest(range(256)) i)),
    tbl as (select list(v order by i) t from steps),
    runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) r from documents),
    low as (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') r, count(*) c from runs group by all),
    bytes as (
        select r, c, list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || r, ''),
            lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] end))) b from low where length(r) >= 5
    ),
    h as (select r, c, xor(4294967295, list_reduce(b, lambda s, x: xor(t[(xor(s, x) & 255) + 1], s >> 8))) h from bytes, tbl),
    w as (select case when h % 97 = 0 then r[1:h % length(r)] || r[h % length(r) + 2:] else r end word, c from h),
    n as (select word, sum(c)::bigint n from w where length(word) >= 5 group by word having sum(c) >= 3),
    cut as (select word, n, length(word) len, i, word[1:i - 1] || word[i + 1:] rest from (select word, n, unnest(range(1, length(word) + 1)) i from n)),
    near as (
        select a.word, b.word other, b.n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.len = b.len and a.word <> b.word
        union select a.word, b.word, b.n from cut a join n b on a.rest = b.word
        union select b.word, a.word, a.n from cut a join n b on a.rest = b.word
    ),
    best as (select word, count(*)::bigint n_near, arg_min(other, (-n, other)) best, max(n) best_n from near group by word),
    f as (select n.word, n.n, coalesce(n_near, 0)::bigint n_near, case when best_n >= 2 * n.n then best end form, case when best_n >= 2 * n.n then best_n end form_n from n left join best using (word)),
    walk as (with recursive w as (select word, form tip from f where form is not null union all select w.word, f.form from w join f on f.word = w.tip where f.form is not null) select * from w),
    ends as (select walk.word, walk.tip root from walk join f on f.word = walk.tip where f.form is null)
    select f.word, f.form, coalesce(root, f.word) root, f.n, f.n_near, f.form_n::bigint form_n from f left join ends using (word)
    """
)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, how many others are one edit away, and the frequent form each goes back to."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query()
def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms near it that the corpus shows to give it away."""
    return disclosure.report(table(spark, sf_dir, "documents"))
