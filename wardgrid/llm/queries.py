"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardgrid.llm.chat import format_chats
from wardgrid.llm.common import shared_dir, table
from wardgrid.llm.decontamination import JOINT, MIN_WORDS, NUMBERS, OPENERS, SHARE, SIGNS, UNITS, VERBATIM_WORDS, WINDOW, leaks
from wardgrid.llm.hard_negatives import mine
from wardgrid.llm.importance import resample
from wardgrid.llm.licenses import LAST_RESORT, everything, pattern, scan_licenses
from wardgrid.llm.lm_scoring import score_texts
from wardgrid.llm.near_dedup import near_duplicates
from wardgrid.llm.neighbours import search
from wardgrid.llm.packing import pack
from wardgrid.llm.sentence_pieces import round_trip
from wardgrid.llm.sharding import shard_documents
from wardgrid.llm.token_counts import count_tokens
from wardgrid.llm.toxicity import score_toxicity


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_minhash_near_dedup, op3_token_counts, op4_lm_scoring, op5_nearest_neighbours, op6_sharding, op7_best_fit_packing, op8_chat_formatting, op9_decontamination, op10_toxicity, op11_sentence_pieces, op12_hard_negatives, op13_importance_resampling)}


def _license_sql() -> str:
    """Rules are tried one after the other: each step takes its matches out of the sequence."""
    sentences, rules = everything()
    known = ", ".join(f"('{i}', '{t.replace(' ', '  ')}')" for i, t in sentences.items())
    steps, last, names, hits = [], "seq", [], []
    for k, (name, ids) in enumerate(rules):
        key = "," + ",,".join(map(str, ids)) + ","
        steps.append(f"s{k} as (select *, ((length(r{k}) - length(replace(r{k}, '{key}', ''))) / {len(key)})::int as h{k}, replace(r{k}, '{key}', ',!,') as r{k + 1} from {last})")
        last = f"s{k}"
        names.append(f"case when h{k} > 0 then '{name}' end")
        hits.append(f"h{k}")
    return f"""
    with known(id, sentence) as (values {known}),
    docs as (select doc_id, row_number() over () as nr, '  ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || '  ' as words from documents),
    hits as (select nr, unnest(m) as sentence, generate_subscripts(m, 1) as place from (select nr, regexp_extract_all(words, '{pattern(sentences)}', 1) as m from docs)),
    found as (select nr, string_agg(id, ',,' order by place) as ids, count(*) as n from hits join known using (sentence) group by nr),
    seq as (select doc_id, coalesce(n, 0)::int as n_sentences, ',' || coalesce(ids, '') || ',' as r0 from docs left join found using (nr)),
    {", ".join(steps)}
    select doc_id, array_to_string(case when len(list_filter(names, lambda x: x <> '{LAST_RESORT}')) > 0 then list_filter(names, lambda x: x <> '{LAST_RESORT}') else names end, ',') as licenses, n_sentences, n_matches
    from (select doc_id, n_sentences, list_sort(list_distinct(flatten(list_transform(list_filter([{", ".join(names)}], lambda x: x is not null), lambda x: string_split(x, ','))))) as names, ({" + ".join(hits)})::int as n_matches from {last})
    """


_CHAT_SQL = r"""
with turns as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
plain as (select *, regexp_replace(regexp_replace(role, '[\r\n]+', ' ', 'g'), '<(\\*)\|im_', '<\1\\|im_', 'g') as r, regexp_replace(text, '<(\\*)\|im_', '<\1\\|im_', 'g') as x from turns),
told as (select conv_id, count(*) as n_turns, list({'role': role, 'text': text} order by turn, role, text) as t, string_agg('<|im_start|>' || r || chr(10) || x || '<|im_end|>' || chr(10), '' order by turn, role, text) as rendered from plain group by conv_id),
one as (select min(conv_id) as conv_id, n_turns, count(*) as n_copies, t, any_value(rendered) as rendered from told group by n_turns, t),
cut as (select distinct k as n_turns, t[1:k] as t from (select t, unnest(range(1, n_turns)) as k from one)),
kept as (select * from one where not exists (select 1 from cut where cut.n_turns = one.n_turns and cut.t = one.t)),
homes as (select k as n_turns, t[1:k] as t, min(conv_id) as kept_id from (select conv_id, t, unnest(range(1, n_turns)) as k from kept) group by 1, 2),
gone as (select kept_id, sum(n_copies) as n_prefixes from one join homes using (n_turns, t) group by 1)
select conv_id, n_turns, n_copies, coalesce(n_prefixes, 0)::bigint as n_prefixes, rendered from kept left join gone on kept_id = conv_id
"""


def _leak_sql() -> str:
    units, numbers, openers = (", ".join(f"'{u}'" for u in listed) for listed in (UNITS, NUMBERS, OPENERS))
    plain = "coalesce(text, '')"
    for sign, name in SIGNS.items():
        plain = f"replace({plain}, '{sign}', ' {name} ')"
    apart = rf"regexp_replace(regexp_replace({plain}, '(\d)[.,](\d)', '\1{JOINT}\2', 'g'), '(\d)(\p{{L}})', '\1 \2', 'g')"
    words = rf"string_split(substring(rtrim(regexp_replace(regexp_replace('.' || {apart}, '[.!?:;\n][^\p{{L}}\p{{N}}]*', ' .', 'g'), '[^\p{{L}}\p{{N}}.{JOINT}]+', ' ', 'g'), ' .'), 2), ' ')"
    bare = "lower(ltrim(x, '.'))"
    template = rf"case when regexp_matches(x, '\d') then '<num>' when regexp_matches(x, '^\p{{Lu}}') or regexp_matches(x, '^\.\p{{Lu}}') and {bare} not in ({openers}) then '<name>' when {bare} in ({units}) then '<unit>' when {bare} in ({numbers}) then '<number>' else {bare} end"
    # t: template words; c: where runs start; h and v: template word and value of each run
    runs = lambda rows: f"""(select *, list_transform(c, lambda i: case t[i] when '<number>' then '<num>' else t[i] end) as h, list_transform(range(1, len(c) + 1), lambda j: array_to_string(list_transform(w[c[j]:coalesce(c[j + 1] - 1, len(w))], lambda x: {bare}), ' ')) as v
        from (select *, list_filter(range(1, len(t) + 1), lambda i: i = 1 or t[i] <> t[i - 1] or t[i] not in ('<name>', '<num>') or t[i] = '<name>' and (w[i][1] = '.' or w[i - 1][1] = '.')) as c from (select *, list_transform(w, lambda x: {template}) as t from {rows})))"""  # noqa: E731
    cut = lambda rows, key: f"select {key}, k, i as place, h[i:i + k - 1] as h, list_transform(list_filter(range(i, i + k), lambda j: h[j][1] = '<'), lambda j: v[j]) as v from (select *, unnest(range(1, len(h) - k + 2)) as i from {rows})"
    return f"""
    with texts as (select text, {words} as w from (select distinct text from benchmark where text is not null)),
    items as (select *, false as turned, least(len(h), {WINDOW}) as k from {runs("texts")} where len(h) >= {MIN_WORDS}),
    inside as (select text, list_prepend(ltrim(w[1], '.'), w[2:]) as w, h as own from items where len(h) <= {WINDOW}),
    turned as (select *, true as turned, least(len(h), {WINDOW}) as k from {runs("inside")} where len(h) >= {MIN_WORDS} and h <> own),
    bw as (select *, h as key from ({cut("items", "text, turned")}) union all select text, turned, k, place, own, v, h from ({cut("turned", "text, turned, own")})),
    docs as (select * from {runs(f"(select distinct doc_id, text as body, {words} as w from documents)")}),
    dw as ({cut("(select *, unnest(range(" + str(MIN_WORDS) + ", " + str(WINDOW + 1) + ")) as k from docs)", "doc_id, body")}),
    met as (select dw.doc_id, dw.body, bw.text, dw.place - bw.place as shift, bw.place, bw.h, bw.v as g, dw.v as f, bw.v = dw.v as verbatim from dw join bw on dw.k = bw.k and dw.h = bw.key where len(bw.v) = len(dw.v) and (not turned or bw.v[1] = dw.v[1])),
    slots as (select doc_id, body, text, shift, unnest(g) as g, unnest(f) as f from met),
    torn as (select doc_id, body, text, shift, true as torn from slots group by all having count(distinct (g, f)) <> count(distinct g)),
    rows as (select doc_id, body, text, shift, count(distinct case when verbatim then place end) as n from met group by all),
    need as (select text, greatest(1, ceil(count(distinct h) * {SHARE})) as need from bw where not turned group by 1),
    kept as (select met.doc_id, met.body, met.text, met.h, n from met left join torn on met.doc_id is not distinct from torn.doc_id and met.body = torn.body and met.text = torn.text and met.shift = torn.shift
        join rows on met.doc_id is not distinct from rows.doc_id and met.body = rows.body and met.text = rows.text and met.shift = rows.shift where torn is null or verbatim),
    found as (select doc_id, body, text, count(distinct h) as n_windows, max(n) as n from kept group by all)
    select doc_id, item_id, max(n_windows) as n_windows from found join need using (text) join (select distinct item_id, text from benchmark) using (text) where n_windows >= need or n > {VERBATIM_WORDS - WINDOW} group by all
    """


_HARD_SQL = """
with rows as (select distinct vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
keyed as (select *, row_number() over (order by vec_id, label, v) as nr from rows),
scored as (select a.nr as anchor, a.vec_id as anchor_id, r.nr, r.vec_id, r.label = a.label as same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i]))::bigint as score
    from keyed a join keyed r on a.nr <> r.nr and len(a.v) = len(r.v) where a.vec_id % 50 = 0),
positives as (select anchor, anchor_id, nr as positive, vec_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor order by score desc, vec_id, nr) <= 5),
hard as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor, p.positive order by s.score desc, s.vec_id, s.nr)::int as rank
    from positives p join scored s on s.anchor = p.anchor where not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from hard where rank <= 3
"""

_IMPORTANCE_SQL = r"""
with step as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) as crc_of),
told as (select row_number() over () as nr, 's' as side, doc_id, text from documents union all select row_number() over (), 't', null, text from benchmark),
words as (select nr, side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from told),
counts as (select side, nr, word, count(*) as n from words group by all),
spelt as (select word, list_transform(range(0, (length(hex(encode(word))) // 2)::bigint), lambda i: ('0x' || hex(encode(word))[2 * i + 1 : 2 * i + 2])::bigint) as bytes from (select distinct word from counts)),
buckets as (select word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]))::bigint, 4294967295) % 10000 as bucket from spelt, step),
per as (select bucket, coalesce(sum(n) filter (side = 's'), 0) as s, coalesce(sum(n) filter (side = 't'), 0) as t from counts join buckets using (word) group by 1),
sums as (select coalesce(sum(n) filter (side = 's'), 0) as all_s, coalesce(sum(n) filter (side = 't'), 0) as all_t from counts),
gains as (select bucket, floor(1000 * ln((t::double + 1.0) * (all_s::double + 10000.0) / ((s::double + 1.0) * (all_t::double + 10000.0))))::bigint as gain from per, sums),
weights as (select nr, sum(n)::bigint as n_features, sum(n * gain)::bigint as gain from counts join buckets using (word) join gains using (bucket) where side = 's' group by 1),
scored as (select nr, doc_id, coalesce(n_features, 0) as n_features, coalesce((gain - ((gain % n_features) + n_features) % n_features) // n_features, 0)::bigint as weight, ('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint as h from told left join weights using (nr) where side = 's'),
drawn as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from scored),
placed as (select nr, row_number() over (order by score desc, doc_id, n_features, weight) as rank, count(*) over () as n from drawn where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= (10 * n) // 100 then rank end as rank from drawn left join placed using (nr)
"""

ORACLE_SQL: dict[str, str] = {"op9_decontamination": _leak_sql(), "op1_license_scan": _license_sql(), "op8_chat_formatting": _CHAT_SQL, "op12_hard_negatives": _HARD_SQL, "op13_importance_resampling": _IMPORTANCE_SQL}
