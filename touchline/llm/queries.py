"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from . import alignment, collocations, decontamination, jaccard_join, language_id, packing, path_tree, quality_neighbours, quality_rules, sentencepiece_bpe, substring_dedup, suffix_dedup, toxicity, url_templates


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """File of a public tokenizer, by default the 32k BPE model; a parameter of the operators, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark, sf_dir):
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_path_template_tree(spark, sf_dir):
    return path_tree.judge(table(spark, sf_dir, "pages"))


def op7_url_templates(spark, sf_dir):
    return url_templates.judge(table(spark, sf_dir, "pages"))


def op7_url_templates_by_host(spark, sf_dir):
    return url_templates.judge(table(spark, sf_dir, "pages"), by_host=True)


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op9_quality_neighbours(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_neighbours.predict(docs, quality_neighbours.fit(docs, table(spark, sf_dir, "labels")))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark, sf_dir):
    return packing.report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_tokenizer_alignment(spark, sf_dir):
    return alignment.report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


def op13_collocations(spark, sf_dir):
    return collocations.report(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_substring_dedup,
        op3_language_id,
        op4_quality_rules,
        op5_sentencepiece,
        op6_toxicity,
        op7_path_template_tree,
        op7_url_templates,
        op7_url_templates_by_host,
        op8_suffix_dedup,
        op9_quality_neighbours,
        op10_jaccard_join,
        op11_best_fit_packing,
        op12_tokenizer_alignment,
        op13_collocations,
        pipeline,
    )
}

_RULES = sorted(url_templates.RULES, key=lambda r: (-len(r[1] + r[2]), r))
_FIT = [f"(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')" for _, h, p in _RULES]


def _url_sql(by_host: bool = False) -> str:
    u = url_templates
    steps = ["t0 as (select *, string_split(shape, '/') as part, string_split(shape, '/')[1] as template from leaves)"]
    for d in range(1, u.DEPTH + 1):
        steps.append(f"""w{d} as (select host, template, true as wild from (
    select host, template, part[{d + 1}] as own, sum(n) as n from t{d - 1} where len(part) > {d} group by all) x
  group by host, template having count(*) >= {u.MIN_CHILDREN} and count(*) >= {u.MIN_NEW_SHARE} * sum(n))""")
        steps.append(f"""t{d} as (select t.* exclude (template), case when len(part) > {d}
    then t.template || '/' || case when wild then '*' else part[{d + 1}] end else t.template end as template
  from t{d - 1} t left join w{d} w on t.host = w.host and t.template = w.template)""")
    return f"""
with base as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages),
ruled as (
  select *, regexp_replace(path, '[0-9]+', '#', 'g') as shape,
         case {" ".join(f"when {f} then '{h + p}'" for f, (_, h, p) in zip(_FIT, _RULES, strict=True))} end as rule,
         case {" ".join(f"when {f} then '{v}'" for f, (v, _, _) in zip(_FIT, _RULES, strict=True))} end as said
  from base),
leaves as (
  select host, shape, count({"distinct path" if by_host else "*"}) as n, count(said) as labelled, count(*) filter (where said = 'block') as blocked
  from ruled group by host, shape),
{", ".join(steps)},
t as (select * exclude (template), template || case when len(part) > {u.DEPTH + 1} then '/' || array_to_string(part[{u.DEPTH + 2}:], '/') else '' end as template from t{u.DEPTH}),
total as (select (sum(blocked) + 1)::double / (sum(labelled) + 2) as share from t),
leaf as (
  select *, regexp_extract(template, '^(.*)/[^/]*$', 1) as parent,
         case when l >= {u.MIN_LABELLED} then cast(floor(10 * (b + 1) / (l + 2)) as int) else -1 end as tenth
  from (select host, template, sum(blocked) as b, sum(labelled) as l from t group by host, template) x),
merged as (select host, parent, tenth, sum(b) as mb, sum(l) as ml from leaf group by all),
hosts as (select host, sum(b) as hb, sum(l) as hl from leaf group by host),
judged as (
  select leaf.host, leaf.template, ml,{" hl," if by_host else ""} (mb + {u.TEMPLATE_WEIGHT} * (hb + {u.HOST_WEIGHT} * share) / (hl + {u.HOST_WEIGHT})) / (ml + {u.TEMPLATE_WEIGHT}) as purity
  from leaf join merged using (host, parent, tenth) join hosts on leaf.host = hosts.host, total)
select page_id, ruled.host, path, rule,
       coalesce(said, case when {f"(ml >= {u.MIN_LABELLED} or hl >= {u.MIN_LABELLED})" if by_host else f"ml >= {u.MIN_LABELLED}"} and purity >= {u.MIN_PURITY} then 'block' else 'allow' end) as verdict
from ruled join t on ruled.host = t.host and ruled.shape = t.shape
  join judged on t.host = judged.host and t.template = judged.template"""


def _tree_sql() -> str:
    t = path_tree
    share = lambda base, n, b: f"({b} + {t.WEIGHT} * {base}) / ({n} + {t.WEIGHT})"
    return f"""
with recursive base as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages),
ruled as (
  select *, regexp_replace(path, '[0-9]+', '#', 'g') as shape,
         case {" ".join(f"when {f} then '{h + p}'" for f, (_, h, p) in zip(_FIT, _RULES, strict=True))} end as rule,
         case {" ".join(f"when {f} then '{v}'" for f, (v, _, _) in zip(_FIT, _RULES, strict=True))} end as said
  from base),
leaves as (
  select host, shape, count(*) as n, count(said) as labelled, count(*) filter (where said = 'block') as blocked
  from (select distinct host, path, shape, said from ruled) x group by host, shape),
grown as (
  select host, shape, n, labelled, blocked, string_split(shape, '/') as part, 0 as d, string_split(shape, '/')[1] as node from leaves
  union all
  select g.host, g.shape, g.n, g.labelled, g.blocked, g.part, g.d + 1, g.node || '/' || case when w.host is null then g.part[g.d + 2] else '*' end
  from grown g left join (
    select host, node from (select host, node, part[d + 2] as own, sum(n) as n from grown where len(part) > d + 1 group by all) c
    group by host, node having count(*) >= {t.MIN_CHILDREN} and count(*) >= {t.MIN_NEW_SHARE} * sum(n)) w on w.host = g.host and w.node = g.node
  where len(g.part) > g.d + 1),
total as (select (coalesce(sum(blocked), 0) + 1)::double / (coalesce(sum(labelled), 0) + 2) as share from leaves),
hosts as (select host, sum(labelled) as l, sum(blocked) as b from leaves group by host),
nodes as (select host, node, sum(labelled) as l, sum(blocked) as b from grown group by host, node),
way as (
  select h.host, null::varchar as shape, -1 as d, {share("total.share", "h.l", "h.b")} as share, h.l as l from hosts h, total
  union all
  select w.host, g.shape, g.d,
    case when n.l > 0 and abs(n.b / n.l - w.share) > {t.Z} * sqrt(w.share * (1 - w.share) / n.l) then {share("w.share", "n.l", "n.b")} else w.share end,
    case when n.l > 0 and abs(n.b / n.l - w.share) > {t.Z} * sqrt(w.share * (1 - w.share) / n.l) then n.l else w.l end
  from way w join grown g on g.host = w.host and g.d = w.d + 1 and (w.shape is null or w.shape = g.shape) join nodes n on n.host = g.host and n.node = g.node),
ends as (select w.host, w.shape, w.share, w.l from way w join leaves s on s.host = w.host and s.shape = w.shape where w.d = len(string_split(w.shape, '/')) - 1)
select page_id, r.host, path, rule, coalesce(said, case when e.l >= {t.MIN_LABELLED} and e.share >= {t.MIN_PURITY} then 'block' else 'allow' end) as verdict
from ruled r join ends e on e.host = r.host and e.shape = r.shape"""


_STOP = ", ".join(f"'{form}'" for w in quality_rules.STOP_WORDS for form in dict.fromkeys((w, w.capitalize())))



def _collocation_sql() -> str:
    c = collocations
    cut = lambda a, b: f"array_to_string(string_split(phrase, ' ')[{a}:{b}], ' ')"
    return f"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\\x0A-\\x0D]+')) as piece
  from documents),
split as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
total as (select lang, sum(len(w))::hugeint as n from split group by lang),
grams as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from split, (select unnest(range(1, {c.LONGEST + 1})) as k) s where len(w) >= k) x),
counts as (select lang, k, phrase, count(*) as a from grams group by all having count(*) >= {c.MIN_COUNT}),
cuts as (select lang, phrase, k, a, j, {cut("1", "j")} as head, {cut("j + 1", "k")} as rest
  from (select *, unnest(range(1, k)) as j from counts where k > 1) x),
scores as (select c.lang, c.phrase, c.k, c.a, c.j, l.a as l, r.a as r, t.n, (1000::hugeint * c.a * t.n) // (l.a::hugeint * r.a) as score
  from cuts c join counts l on l.lang = c.lang and l.phrase = c.head join counts r on r.lang = c.lang and r.phrase = c.rest join total t on t.lang = c.lang),
lowest as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) as o from scores) x where o = 1),
inside as (select lang, {cut("s", "s + m - 1")} as phrase, max(a) as longer
  from (select *, unnest(range(1, k - m + 2)) as s from (select *, unnest(range(2, k)) as m from counts where k > 2) x) y group by all),
kept as (select w.* from lowest w left join inside i on i.lang = w.lang and i.phrase = w.phrase where i.longer is null or 100 * i.longer < {c.CONTAINED} * w.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked where rank <= {c.TOP}"""


ORACLE = {
    "op13_collocations": _collocation_sql(),
    "op7_path_template_tree": _tree_sql(),
    "op7_url_templates": _url_sql(),
    "op7_url_templates_by_host": _url_sql(by_host=True),
    "op4_quality_rules": f"""
with d as (
  select doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws,
         string_split(coalesce(text, ''), chr(10)) as ls
  from documents),
tok as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
words as (
  select doc_id, count(*) as n_words, sum(length(w)) as word_chars,
         count(*) filter (where w in ({_STOP})) as n_stop
  from tok group by doc_id),
tri as (
  select doc_id, i, w as a, lead(w, 1) over s as b, lead(w, 2) over s as c
  from tok window s as (partition by doc_id order by i)),
rep as (
  select doc_id, i, count(*) over (partition by doc_id, a, b, c) as k from tri where c is not null),
hit as (
  select distinct doc_id, i + o.o as i from rep, (select unnest([0, 1, 2]) as o) o where k > 1),
repeated as (select doc_id, count(*) as n from hit group by doc_id),
lines as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup
  from (select doc_id, unnest(ls) as l from d) x where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by doc_id),
counts as (
  select d.doc_id, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
         coalesce(n_stop, 0) as n_stop,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         length(regexp_replace(t, '[^!]', '', 'g')) as n_excl,
         coalesce(n_lines, 0) as n_lines, coalesce(n_dup, 0) as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words
  from d left join words using (doc_id) left join lines using (doc_id) left join repeated using (doc_id)),
judged as (
  select *, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words as base_failed,
         case when n_words > 0 then word_chars::double / n_words else 0 end as word_chars_per_word,
         case when n_words > 0 then n_symbols::double / n_words else 0 end as symbols_per_word,
         case when n_words > 0 then n_stop::double / n_words else 0 end as stop_words_per_word,
         case when n_lines > 0 then n_dup_lines::double / n_lines else 0 end as dup_lines_per_line,
         case when n_words > 0 then n_excl::double / n_words else 0 end as exclamations_per_word
  from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {" and ".join(f"{m} between {lo} and {hi}" for _, m, lo, hi in quality_rules.RULES)} as kept
from judged""",
}
