"""The thin queries of the thirteen operators, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, chat, embeddings, langid, minhash, mixing, packing, pii, quality, spelling, tokens, trie, urls

#: op6's rules, by contract.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    out = langid.identify(docs, train=~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    made = chat.read_back(chat.formatted(chat.chain(turns.unionByName(extra))))
    digest = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.judge(_table(spark, sf_dir, "pages"), labels, RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_pii")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "lang", "symbols", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def words() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = tokens.write(_table(spark, sf_dir, "documents"), words())
    return written.read().select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.rebuilt(_table(spark, sf_dir, "conversations"))
    return trie.nodes(turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spelling.words(_table(spark, sf_dir, "documents"))
    return spelling.variants(counted)


def queries() -> dict:
    own = (op1_language_id, op2_chat_formatting, op3_minhash_dedup, op4_source_mixing, op5_nearest_neighbours, op6_url_filter, op7_pii_pseudonyms, op8_embedding_dedup, op9_quality_classifier, op10_packing, op11_token_files, op12_prefix_trie, op13_spelling_variants)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": OP2, "op6_url_filter": OP6}


#: The same digests from the turns themselves.  formatted_chars follows from the template: 34 characters of markers a turn, and escapes.
OP2 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), one as (
  select *, length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>|/?SYS>>)', '\1\\\2\3', 'g'))
          + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>|/?SYS>>)', '\1\\\2\3', 'g')) + 32 as chars
  from turns
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars
from one group by conv_id
"""

#: Rules and the three levels of shrinkage; each strength is the moment estimate of urls._strength.
OP6 = r"""
with seen as (
  select doc_id as page_id, count(*) as n, sum(cast(quality = 0 or toxic = 1 as int)) as bad from labels where (quality = 0 or toxic = 1) is not null group by 1
), p as (
  select page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') as path from pages
), h0 as (
  select host, regexp_replace(host, ':\d*$', '') as bare, coalesce(sum(n), 0) as n, coalesce(sum(bad), 0) as bad from p left join seen using (page_id) group by 1
), h1 as (
  select *, regexp_replace(regexp_extract(bare, '((?:(?:^|\.)(?:ac|co|com|edu|gov|net|org)\.[a-z]{2})|(?:(?:^|\.)[^.]*))$', 1), '^\.', '') as suffix from h0
), h as (
  select *, regexp_extract(substr(bare, 1, length(bare) - length(suffix)), '([^.]*\.)$', 1) || suffix as domain from h1
), s0 as (
  select suffix, sum(n) as n, sum(bad) as bad, (select (sum(bad) + 1.0) / (sum(n) + 2.0) from h) as prior from h group by 1
), ks as (select STRENGTH as k from s0 where n > 0 and prior * (1 - prior) > 0), s as (
  select suffix, (bad + k * prior) / (n + k) as up from s0, ks
), d0 as (
  select domain, s.up as prior, sum(n) as n, sum(bad) as bad from h join s using (suffix) group by 1, 2
), kd as (select STRENGTH as k from d0 where n > 0 and prior * (1 - prior) > 0), d as (
  select domain, (bad + k * prior) / (n + k) as up from d0, kd
), e as (select host, n, bad, d.up as prior from h join d using (domain)), kh as (select STRENGTH as k from e where n > 0 and prior * (1 - prior) > 0), post as (
  select host, bad + k * prior as a, n - bad + k * (1 - prior) as b from e, kh
), r as (
  select p.*, case when starts_with(path, '/en/') and (host = 'example.net' or ends_with(host, '.example.net')) then 'example.net/en/'
    when starts_with(path, '/de/') and (host = 'example.com' or ends_with(host, '.example.com')) then 'example.com/de/'
    when starts_with(path, '/fr/') and (host = 'org' or ends_with(host, '.org')) then 'org/fr/'
    when starts_with(path, '/') and (host = 'net' or ends_with(host, '.net')) then 'net/' end as rule,
    a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) as low from p join post using (host)
)
select page_id, host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' when low > 0.5 then 'block' else 'allow' end as verdict from r
""".replace("STRENGTH", """case when coalesce(sum(n * (n - 1)), 0) = 0 then 10.0
  when sum(pow(bad - n * prior, 2) / (prior * (1 - prior)) - n) / sum(n * (n - 1)) <= 0 then 1000.0
  else least(1000.0, greatest(1.0, 1 / (sum(pow(bad - n * prior, 2) / (prior * (1 - prior)) - n) / sum(n * (n - 1))) - 1)) end""")
