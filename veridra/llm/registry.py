"""The query of each operator with its production parameters, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_digests
from .common import read
from .exact_dedup import mark_duplicates
from .language_id import identify_languages
from .merkle import verify_tampering
from .mixing import mix, targets_sql
from .near_dedup import near_duplicates
from .order_minhash import fingerprint_documents
from .phrases import collocations
from .quality import score_quality
from .secret_scan import KINDS, scan_secrets
from .token_files import count_document_tokens
from .toxicity import score_documents
from .url_rules import filter_urls

#: The rules of the query: host, path, action.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
MIX = {"weights": (3.0, 1.0, 2.0), "share": 1.5, "cap": 2.0}


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return filter_urls(read(spark, sf_dir, "pages"), rules)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), **MIX).select("doc_id", "size", "source_size", "target", "taken")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=80)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def vocabulary() -> tuple[str, str]:
    """The path of the public byte-level vocabulary, and the pattern that cuts texts."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"), *vocabulary())


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_document_tokens(read(spark, sf_dir, "documents"), *vocabulary())


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"), least=30, covered=80, top=2000)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_tampering(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_secret_scan": op7_secret_scan,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_token_counts": op9_token_counts,
    "op5_url_filters": op5_url_filters,
    "op10_mix_sources": op10_mix_sources,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: A bit of each column's leaf, and CRC-32, which DuckDB lacks, of the decimal digits of doc_id.
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars")) + " || coalesce(strlen({0})::varchar || ':' || {0}, '-'))"
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295)"""

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)

ORACLE = {
    "op1_near_dedup": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) < 4 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as sh from w where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select p.a, p.b from (select x.doc_id as a, y.doc_id as b, count(*) as both from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by 1, 2) p
  join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * p.both >= 80 * (na.n + nb.n - p.both)),
reach(doc_id, low) as (select doc_id, doc_id from documents union select l.b, r.low from reach r join links l on l.a = r.doc_id where r.low < l.b),
c as (select doc_id, min(low) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n using (doc_id) left join c using (doc_id)""",
    "op2_exact_dedup": r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as content from documents)
select doc_id, first_value(doc_id) over (partition by content order by length(text) desc, doc_id nulls last) as keep_id,
  count(*) over (partition by content) as group_size,
  doc_id is not distinct from first_value(doc_id) over (partition by content order by length(text) desc, doc_id nulls last) as kept,
  sha256(content) as text_sha256 from d""",
    "op5_url_filters": rf"""
with rules(rhost, rpath, action) as (values {_RULE_ROWS}),
p as (select page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages)
select page_id, host, path,
  (select arg_max(rhost || rpath, length(rhost || rpath)) from rules where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as rule,
  coalesce((select arg_max(action, length(rhost || rpath)) from rules where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)), 'allow') as verdict
from p""",
    "op10_mix_sources": rf"""
with docs as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  ('0x' || left(md5(coalesce(doc_id::varchar, '') || chr(1) || coalesce(text, '')), 8))::bigint as h from documents),
sources as (select source, sum(size)::bigint as source_size from docs group by source),
{targets_sql(MIX["weights"], MIX["share"], MIX["cap"], duckdb=True).strip()},
summed as (select d.doc_id, d.size, t.source_size, t.target,
  case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as whole,
  sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row)::bigint as upto,
  sum(d.size) over (partition by d.source, d.h)::bigint as alike
  from docs d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (whole + case when 2 * (target - whole * source_size - (upto - alike)) > alike then 1 else 0 end))::bigint as taken from summed""",
    "op11_phrase_collocations": r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
n as (select lang, sum(len(ws))::bigint as n from w group by lang),
f as (select lang, k, phrase, count(*) as f from (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase from w, (values (1), (2), (3), (4)) x(k) where len(ws) >= k) group by all having count(*) >= 30),
cuts as (select lang, phrase, k, f as a, string_split(phrase, ' ') as ws, unnest(range(1, k)) as j from f where k > 1),
scored as (select c.lang, c.phrase, c.k, c.a, l.f as l, r.f as r, (2000000::hugeint * c.a) // (l.f + r.f) as score, row_number() over (partition by c.lang, c.phrase order by (2000000::hugeint * c.a) // (l.f + r.f), j) as place
  from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(c.ws[:c.j], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.ws[c.j + 1:], ' ')),
kept as (select * from scored c where place = 1 and not exists (select 1 from f b where b.lang = c.lang and b.k > c.k and 100 * b.f >= 80 * c.a and contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join n using (lang) where rank <= 2000""",
    "op13_merkle_manifest": rf"""
with recursive rows as (select doc_id, source, {_LEAF.format("text")} as leaf, {_LEAF.format("replace(text, chr(10), '')")} as cut, {_CRC} % 2 = 0 as even from documents),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, row_number() over () as r from rows),
t(source, level, idx, node, n) as (select source, 0, pos, leaf, count(*) over (partition by source) from placed
  union all select source, level + 1, idx // 3, sha256(string_agg(node, '' order by idx)), (any_value(n) + 2) // 3 from t where n > 1 group by source, level, idx // 3),
subroots as (select source, node as subroot, row_number() over (order by source nulls first) - 1 as pos from t where n = 1),
o(level, idx, node, n) as (select 0, pos, subroot, count(*) over () from subroots
  union all select level + 1, idx // 3, sha256(string_agg(node, '' order by idx)), (any_value(n) + 2) // 3 from o where n > 1 group by level, idx // 3),
runs as (select source, level, idx // 3 as idx, string_agg(node, '' order by idx) as run from t where n > 1 group by source, level, idx // 3),
outer_runs as (select level, idx // 3 as idx, string_agg(node, '' order by idx) as run from o where n > 1 group by level, idx // 3),
sides as (select r, level as k, run, p.pos // (3 ** level)::bigint % 3 * 64 as cut from placed p join runs on runs.source is not distinct from p.source and runs.idx = p.pos // (3 ** (level + 1))::bigint
  union all select r, 1000 + level, run, s.pos // (3 ** level)::bigint % 3 * 64 from placed p join subroots s on s.source is not distinct from p.source join outer_runs u on u.idx = s.pos // (3 ** (level + 1))::bigint),
path as (select r, row_number() over (partition by r order by k) as k, left(run, cut) as before, substr(run, cut + 65) as after from sides),
folded(r, k, node) as (select r, 0, case when even then cut else leaf end from placed union all select f.r, f.k + 1, sha256(before || node || after) from folded f join path p on p.r = f.r and p.k = f.k + 1),
ends as (select r, arg_max(node, k) as folded_root from folded group by r),
proofs as (select r, sha256(string_agg(before || after, '' order by k)) as proof from path group by r)
select doc_id, leaf, subroot, root, coalesce(proof, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from placed p join subroots s on s.source is not distinct from p.source cross join (select node as root from o where n = 1) join ends using (r) left join proofs using (r)""",
}
