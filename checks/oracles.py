"""Oracle SQL for DuckDB, written apart from the library's expressions.

RE2 has no lookahead, so a section pattern consumes its stop; group 1 is the same.
"""

from __future__ import annotations

from checks.derived import OPERATIVE_SQL, ULTRASOUND_SQL
from gradeloom.functions.stopwords import ENGLISH

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_IN = WS[1:-1]
STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
TRIM_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def group1(col: str, pattern: str) -> str:
    """Group 1 of the first match, NULL without a match."""
    return f"case when regexp_matches({col}, '{pattern}') then regexp_extract({col}, '{pattern}', 1) end"


def section(col: str, heading: str, stop: str, flags: str = "is") -> str:
    p = f"(?{flags}){heading}[:{WS_IN}]*(.*?)(?:{stop})"
    return f"trim({group1(col, p)}, {TRIM_CHARS})"


def any_of(col: str, terms: list[str]) -> str:
    return "(" + " or ".join(f"contains({col}, '{t}')" for t in terms) + ")"


def report_grade(col: str) -> str:
    return f"""case when {col} is null then null
      when {any_of(col, ['normal', 'unremarkable'])} then 'Normal'
      when {any_of(col, ['simple', 'uncomplicated'])} then 'Simple/Uncomplicated'
      when {any_of(col, ['complicated', 'gangrenous'])} then 'Gangrenous'
      when {any_of(col, ['perforated', 'ruptured', 'abscess'])} then 'Perforated'
      else 'Uncertain' end"""


def response_grade(col: str) -> str:
    low = f"lower({col})"
    return f"""case when {col} is null then 'Unknown'
      when {any_of(low, ['normal', 'no signs of appendicitis', 'appendix is normal'])} then 'Normal'
      when {any_of(low, ['simple', 'uncomplicated', 'not complicated', 'mild', 'not severe', 'no complication'])}
        then 'Simple/Uncomplicated'
      when {any_of(low, ['gangrenous', 'gangrene'])} then 'Gangrenous'
      when {any_of(low, ['perforated', 'perforation', 'rupture', 'perforate'])} then 'Perforated'
      else 'Unknown' end"""


CASE_ID = f"""coalesce({group1('report_text', 'Case ID[:' + WS_IN + r']*([A-Za-z0-9\-]+)')},
    {group1('report_id', r'(CASE-[A-Z0-9]+-\p{Nd}+)')})"""
MDY = rf"([A-Za-z]+{WS}+\p{{Nd}}{{1,2}},{WS}+\p{{Nd}}{{4}})"
EXAM_DATE = "coalesce(" + ", ".join(
    group1("report_text", f"(?i){p}.*?{MDY}") for p in ("Date of exam", "Exam Date", "Date")) + ")"
HEADING_STOP = rf"\n\n|\n[A-Z]+{WS}*[A-Z]*:|$"

US = f"""us_raw as ({ULTRASOUND_SQL}),
us_trim as (select report_id, trim(report_text, {TRIM_CHARS}) as report_text from us_raw),
us_cut as (select report_id, report_text, {CASE_ID} as case_id, {EXAM_DATE} as exam_date,
  {section('report_text', 'CLINICAL INFORMATION', HEADING_STOP)} as clinical_information,
  {section('report_text', 'FINDINGS', 'IMPRESSION|$')} as findings,
  {section('report_text', 'IMPRESSION', r'$|\n\n')} as impression
  from us_trim where report_text <> ''),
us as (select *, {report_grade('lower(impression)')} as severity_grade from us_cut)"""

OP = f"""or_raw as ({OPERATIVE_SQL}),
or_trim as (select report_id, trim(report_text, {TRIM_CHARS}) as report_text from or_raw),
or_cut as (select report_id, report_text, {CASE_ID} as case_id,
  {group1('report_text', '(?i)Date[:' + WS_IN + r']*(\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2})')} as operation_date,
  {section('report_text', 'Surgeon', r'\n|$', 'i')} as surgeon,
  {section('report_text', 'Pre-operative diagnosis', HEADING_STOP)} as preop_diagnosis,
  {section('report_text', 'Post-operative diagnosis', HEADING_STOP)} as postop_diagnosis,
  {section('report_text', 'operative findings', HEADING_STOP)} as operative_findings
  from or_trim where report_text <> ''),
op as (select *, {report_grade('lower(postop_diagnosis)')} as severity_grade from or_cut)"""

PAIRS = f"""{US}, {OP}, pairs as (select us.report_id as report_id_us, op.report_id as report_id_or,
  us.case_id, us.severity_grade as severity_grade_us, op.severity_grade as severity_grade_or
  from us join op on us.case_id is not distinct from op.case_id)"""

GOLD = f"""{PAIRS}, gold as (select report_id_us || '/' || report_id_or as report_id,
  severity_grade_or as gold, severity_grade_us as said from pairs
  where severity_grade_or is not null and severity_grade_us is not null)"""


def flags(lowered: str, table: dict[str, list[str]]) -> str:
    return ", ".join(f"{any_of(lowered, terms)} as {name}" for name, terms in table.items())


US_FLAGS = flags("lower(findings)", {
    "has_free_fluid": ["free fluid"], "has_fat_stranding": ["fat stranding", "hyperechoic fat"],
    "has_lymph_nodes": ["lymph nodes"], "has_appendicolith": ["appendicolith"]})
OR_FLAGS = flags("lower(operative_findings)", {
    "found_perforation": ["perforated", "perforation", "ruptured"], "found_abscess": ["abscess"],
    "found_gangrene": ["gangrenous"], "found_contamination": ["contamination", "purulent", "fibrinous"]})


def clean(col: str) -> str:
    out = f"lower(coalesce({col}, ''))"
    out = rf"regexp_replace({out}, '\p{{Nd}}+', '', 'g')"
    out = rf"regexp_replace({out}, '\[\*.*?\*\]', '', 'g')"
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}_{WS_IN}]', ' ', 'g')"
    return f"trim(regexp_replace({out}, '{WS}+', ' ', 'g'))"


def words(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{WS}+'), lambda w: w <> '')"


KEYWORDS = ["appendicitis", "perforated", "gangrenous", "inflamed", "abscess", "appendicolith", "fluid",
            "thickening", "diameter", "normal", "simple", "complicated", "phlegmon", "contamination"]
KEYWORD_LIST = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"


def keywords(col: str) -> str:
    return f"list_filter({KEYWORD_LIST}, lambda k: contains({col}, k))"


TERM_TOKENS = rf"""list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: t not in ({STOPS}))"""
TERMS = """list_concat(toks, list_transform(range(1, greatest(len(toks), 1)), lambda i: toks[i] || ' ' || toks[i + 1]))"""


def tfidf(train: str, docs: str, max_features: int) -> str:
    """CTEs ``vocab`` and ``weights`` for a fit on ``train`` applied to ``docs``."""
    return f"""fit_toks as (select doc_id, {TERM_TOKENS} as toks from ({train})),
fit_terms as (select doc_id, unnest({TERMS}) as term from fit_toks),
fit_counts as (select term, count(*) as cf, count(distinct doc_id) as df from fit_terms group by term),
n_docs as (select count(*) as n from fit_toks),
top_terms as (select term, cf, df from fit_counts, n_docs
  where df >= 2 and df <= 0.8::double * n order by cf desc, term limit {max_features}),
vocab as (select term, cast(row_number() over (order by term) - 1 as integer) as idx, cf, df,
  ln((n + 1)::double / (df + 1)) + 1 as idf from top_terms, n_docs),
toks as (select doc_id, {TERM_TOKENS} as toks from ({docs})),
cells as (select doc_id, unnest({TERMS}) as term from toks),
tf as (select doc_id, term, count(*) as n from cells group by doc_id, term),
raw_weights as (select doc_id, idx, term, n * idf as w from tf join vocab using (term)),
weights as (select doc_id, idx, term, w / sqrt(sum(w * w) over (partition by doc_id)) as tfidf from raw_weights)"""


def split_ctes(rows: str) -> str:
    """CTE ``placed``: (k, label, split) for rows (k, label), by exact class quotas."""
    return f"""s_rows as ({rows}),
s_counts as (select label, count(*) as c from s_rows group by label),
s_sizes as (select label, c, case when c >= 2 then c else 0 end as u from s_counts),
s_total as (select *, sum(u) over () as n from s_sizes),
s_test_n as (select *, cast(ceil(0.15::double * n) as bigint) as t from s_total),
s_test_f as (select *, (t * u) // n as f, (t * u) % n as r from s_test_n),
s_test as (select *, f + case when row_number() over (order by r desc, label nulls last) <= t - sum(f) over ()
  then 1 else 0 end as n_test from s_test_f),
s_val_n as (select label, c, n_test, u - n_test as u2, n - t as n2,
  cast(ceil((0.15::double / (1 - 0.15::double)) * (n - t)) as bigint) as v from s_test),
s_val_f as (select *, (v * u2) // n2 as f2, (v * u2) % n2 as r2 from s_val_n),
s_val as (select *, f2 + case when row_number() over (order by r2 desc, label nulls last) <= v - sum(f2) over ()
  then 1 else 0 end as n_val from s_val_f),
s_ranked as (select k, label, row_number() over (partition by label order by md5(k || '42'), k) as rn from s_rows),
placed as (select k, r.label, case when rn <= n_test then 'test' when rn <= n_test + n_val then 'val' else 'train' end as split
  from s_ranked r join s_val q on r.label is not distinct from q.label)"""


def metric_ctes(rows: str) -> str:
    """CTEs ``conf``, ``per_class`` and ``overall`` for rows (y, p)."""
    return f"""m_rows as ({rows}),
conf as (select y as truth, p as predicted, count(*) as n from m_rows group by y, p),
m_labels as (select truth as label from conf union select predicted from conf),
m_counts as (select label,
  (select coalesce(sum(n), 0) from conf where truth is not distinct from label) as support,
  (select coalesce(sum(n), 0) from conf where predicted is not distinct from label) as n_predicted,
  (select coalesce(sum(n), 0) from conf where truth is not distinct from label and predicted is not distinct from label) as hits
  from m_labels),
per_class as (select label, case when n_predicted > 0 then hits::double / n_predicted else 0 end as precision,
  case when support > 0 then hits::double / support else 0 end as recall,
  case when support + n_predicted > 0 then 2.0::double * hits / (support + n_predicted) else 0 end as f1_score,
  cast(support as bigint) as support, cast(n_predicted as bigint) as n_predicted, cast(hits as bigint) as hits from m_counts),
overall as (select sum(hits)::double / sum(support) as accuracy, sum(precision * support) / sum(support) as precision,
  sum(recall * support) / sum(support) as recall, sum(f1_score * support) / sum(support) as f1_score,
  sum(support::double * n_predicted) / (sum(support)::double * sum(support)) as chance,
  cast(sum(support) as bigint) as sample_size,
  cast(sum(case when support = 0 then n_predicted else 0 end) as bigint) as unseen_rows from per_class)"""


KAPPA = "(accuracy - chance) / (1 - chance)"
GOLD_ROWS = "select gold as y, said as p from gold"

# Class scores with ties, as exact functions of the key, made to add up to 1.
SCORES = """scored as (select doc_id, cast(doc_id % 3 as integer) as y,
  1 + (doc_id * 7) % 11 + case when doc_id % 3 = 0 then 3 else 0 end as a,
  1 + (doc_id * 5) % 13 + case when doc_id % 3 = 1 then 3 else 0 end as b,
  1 + (doc_id * 3) % 17 + case when doc_id % 3 = 2 then 3 else 0 end as c from documents),
probs as (select doc_id, y, a::double / (a + b + c) as p0, b::double / (a + b + c) as p1,
  c::double / (a + b + c) as p2 from scored)"""

RESPONSES = f"""{US}, answers as (select report_id, severity_grade,
  case cast(regexp_extract(report_id, '([0-9]+)$', 1) as bigint) % 9
    when 0 then 'Not complicated' when 1 then ' no signs of appendicitis ' when 2 then 'mild'
    when 3 then 'rupture' when 4 then 'complicated' when 5 then null else impression end as response from us)"""

ENTITIES = rf"""ents as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') as ents from documents),
ent_counts as (select term, count(*) as freq from (select unnest(ents) as term from ents) group by term having count(*) >= 5),
ent_vocab as (select term, freq, cast(row_number() over (order by term) - 1 as bigint) as idx from ent_counts)"""

PREPARED = f"""{US}, prepared as (select report_id, severity_grade, {clean('report_text')} as cleaned_text from us)"""

COMMA = f"""{US}, kw_rows as (select report_id,
  case when right(report_id, 1) = '7' then null
       when right(report_id, 1) = '3' then ' fluid, ,normal,'
       else list_aggregate({keywords("lower(report_text)")}, 'string_agg', ', ') end as keywords from us)"""

RESULT_ROWS = """select 'Text Rules' as method, 1 as fit_order, * from overall"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["us_report_fields"] = f"""with {US} select report_id, case_id, exam_date, clinical_information, findings,
      try_cast({group1('findings', rf'(?i)appendix.*?(\p{{Nd}}+\.?\p{{Nd}}*){WS}*mm')} as double) as appendix_diameter_mm,
      try_cast({group1('findings', rf'(?i)wall.*?thick.*?(\p{{Nd}}+\.?\p{{Nd}}*){WS}*mm')} as double) as wall_thickness_mm,
      {US_FLAGS}, impression, severity_grade from us"""
    out["or_report_fields"] = f"""with {OP} select report_id, case_id, operation_date, surgeon, preop_diagnosis,
      postop_diagnosis, severity_grade, operative_findings, {OR_FLAGS} from op"""
    for name, null_rule in (("merged_cases", "is not distinct from"), ("merged_cases_drop_null", "=")):
        out[name] = f"""with {US}, {OP} select us.report_id as report_id_us, op.report_id as report_id_or, us.case_id,
          us.severity_grade as severity_grade_us, op.severity_grade as severity_grade_or,
          'ultrasound' as report_type_us, 'operative' as report_type_or, us.findings, op.operative_findings
          from us join op on us.case_id {null_rule} op.case_id"""
    out["grade_pairs"] = f"""with {PAIRS} select severity_grade_us, severity_grade_or, count(*) as n
      from pairs group by severity_grade_us, severity_grade_or"""
    out["extraction_counts"] = r"""select count(*) as total_reports,
      count(*) filter (where regexp_matches(t, '\S')) as successful_reports from (
        select case when doc_id % 7 = 0 then null when doc_id % 7 = 1 then ' ' || chr(10) || ' ' else text end as t from documents)"""
    out["grade_distribution"] = f"""with {US} select severity_grade as label, count(*) as n from us
      where severity_grade is not null group by severity_grade"""
    out["label_map"] = f"""with {US}, l as (select distinct severity_grade as label from us)
      select label, cast(row_number() over (order by label nulls last) - 1 as integer) as label_encoded from l"""
    out["response_grade"] = f"""with {RESPONSES}, every as (
        select report_id, response from answers
        union all select 'c' || conv_id || '-' || turn, text from conversations)
      select report_id, {response_grade('response')} as grade from every"""
    out["clean_text"] = f"select doc_id, {clean('text')} as cleaned_text from documents"
    out["tokens"] = f"select doc_id, array_to_string({words('text')}, '|') as tokens, cast(len({words('text')}) as integer) as n from documents"
    content = rf"list_filter({words('cleaned')}, lambda t: regexp_matches(t, '^\p{{L}}+$') and t not in ({STOPS}))"
    out["token_filter"] = f"""with d as (select doc_id, {clean('text')} as cleaned from documents)
      select doc_id, array_to_string(list_filter({content}, lambda t: length(t) > 2), ' ') as processed_text from d"""
    out["token_lemma"] = f"""with d as (select doc_id, {clean('text')} as cleaned from documents),
      pieces as (select doc_id, unnest({content}) as tok, generate_subscripts({content}, 1) as pos from d),
      lemmas as (select doc_id, pos, case when tok like '%s' and length(tok) > 3 then left(tok, length(tok) - 1) else tok end as lemma from pieces),
      joined as (select doc_id, string_agg(lemma, ' ' order by pos) as processed_text from lemmas where length(lemma) > 2 group by doc_id)
      select doc_id, coalesce(processed_text, '') as processed_text from d left join joined using (doc_id)"""
    out["keyword_tags"] = f"""with {PREPARED} select report_id, array_to_string({keywords('cleaned_text')}, ',') as medical_keywords from prepared"""
    out["prepared_dataset"] = f"""with {PREPARED}, l as (select distinct severity_grade from prepared),
      m as (select severity_grade, cast(row_number() over (order by severity_grade nulls last) - 1 as integer) as label_encoded from l)
      select report_id, p.severity_grade, cleaned_text, cleaned_text as processed_text,
        array_to_string({keywords('cleaned_text')}, ',') as medical_keywords, label_encoded
      from prepared p join m on p.severity_grade is not distinct from m.severity_grade"""
    out["stratified_split"] = f"""with {split_ctes("select cast(doc_id as varchar) as k, lang as label from documents")}
      select cast(k as bigint) as doc_id, label as lang, split from placed"""
    for name in ("softmax_boosting", "leafwise_boosting"):
        out[f"model_{name}"] = f"""with {US}, {split_ctes("select report_id as k, severity_grade as label from us")}
      select '{name}' as model, count(*) as n_scored, true as sums_to_one, true as beats_majority
      from placed where split = 'test'"""
    out["split_sizes"] = f"""with {US}, {split_ctes("select report_id as k, severity_grade as label from us")}
      select split, count(*) as n from placed group by split"""
    all_docs = "select doc_id, text from documents"
    train, test = all_docs + " where lang <> 'fr'", all_docs + " where lang = 'fr'"
    out["tfidf_vocab"] = f"""with {tfidf(all_docs, all_docs, 3000)}
      select term, idx, cf, df, round(idf, 6) as idf from vocab"""
    out["tfidf_features"] = f"""with {tfidf(all_docs, all_docs, 3000)}
      select doc_id, idx, term, round(tfidf, 6) as tfidf from weights"""
    out["tfidf_transform_test"] = f"""with {tfidf(train, test, 1000)}
      select doc_id, idx, term, round(tfidf, 6) as tfidf from weights"""
    out["keyword_vocab"] = f"""with {PREPARED}, k as (select distinct unnest({keywords('cleaned_text')}) as term from prepared)
      select term, cast(row_number() over (order by term) - 1 as bigint) as idx from k"""
    out["keyword_vocab_text"] = f"""with {COMMA}, k as (select distinct trim(unnest(string_split(keywords, ','))) as term from kw_rows where keywords is not null)
      select term, cast(row_number() over (order by term) - 1 as bigint) as idx from k"""
    out["keyword_features"] = f"""with {PREPARED}, kw as (select report_id, {keywords('cleaned_text')} as ks from prepared),
      v as (select distinct unnest(ks) as term from kw), vs as (select list(term order by term) as terms from v)
      select report_id, array_to_string(list_transform(terms, lambda t: case when list_contains(ks, t) then 1 else 0 end), ',') as features
      from kw, vs"""
    out["keyword_features_text"] = f"""with {COMMA}, v as (select distinct trim(unnest(string_split(keywords, ','))) as term from kw_rows where keywords is not null),
      vi as (select term, cast(row_number() over (order by term) - 1 as bigint) as idx from v),
      have as (select distinct report_id, trim(unnest(string_split(keywords, ','))) as term from kw_rows)
      select report_id, idx, term from have join vi using (term) where term <> ''"""
    out["entity_vocab"] = f"with {ENTITIES} select term, freq, idx from ent_vocab"
    out["entity_features"] = f"""with {ENTITIES}, have as (select distinct doc_id, unnest(ents) as term from ents)
      select doc_id, idx, term from have join ent_vocab using (term)"""
    out["text_statistics"] = f"""with d as (select doc_id, text, {words('text')} as w from documents)
      select doc_id, cast(length(text) as integer) as num_chars, cast(len(w) as integer) as num_words,
        round(case when len(w) = 0 then 0 else list_sum(list_transform(w, lambda x: length(x)))::double / len(w) end, 6) as avg_word_length from d"""
    out["onehot_features"] = """with cats as (
        select 'p_brand' as feature, p_brand as category from part where p_partkey % 5 <> 0 group by p_brand
        union all select 'p_type', p_type from part where p_partkey % 5 <> 0 group by p_type
        union all select 'p_name', p_name from part where p_partkey % 5 <> 0 group by p_name),
      c as (select *, cast(row_number() over (partition by feature order by category) - 1 as bigint) as position from cats),
      cells as (select p_partkey, 'p_brand' as feature, p_brand as category from part
        union all select p_partkey, 'p_type', p_type from part
        union all select p_partkey, 'p_name', p_name from part)
      select p_partkey, feature, category, position from cells join c using (feature, category)"""
    cat = lambda c: f"""(select {c}, cast(row_number() over (order by {c}) - 1 as integer) as i
        from part where p_partkey % 5 <> 0 group by {c})"""
    out["onehot_vectors"] = f"""select p_partkey, b.i as p_brand_position, t.i as p_type_position, n.i as p_name_position
      from part left join {cat('p_brand')} b using (p_brand) left join {cat('p_type')} t using (p_type)
      left join {cat('p_name')} n using (p_name)"""
    out["random_sample"] = """select doc_id from documents order by md5(doc_id || '42'), cast(doc_id as varchar) limit 103"""
    gold = f"{GOLD}, {metric_ctes(GOLD_ROWS)}"
    out["confusion_matrix"] = f"with {gold} select truth, predicted, n from conf"
    out["class_report"] = f"""with {gold} select label, round(precision, 6) as precision, round(recall, 6) as recall,
      round(f1_score, 6) as f1_score, support from per_class"""
    out["macro_avg"] = f"""with {gold} select round(avg(precision), 6) as precision, round(avg(recall), 6) as recall,
      round(avg(f1_score), 6) as f1_score, cast(sum(support) as bigint) as support from per_class"""
    out["weighted_metrics"] = f"""with {gold} select round(accuracy, 6) as accuracy, round(precision, 6) as precision,
      round(recall, 6) as recall, round(f1_score, 6) as f1_score, sample_size from overall"""
    out["cohen_kappa"] = f"with {gold} select round({KAPPA}, 6) as kappa from overall"
    ranks = []
    for i in range(3):
        ranks.append(f"""select {i} as cls, y = {i} as pos, rank() over (order by p{i})
          + (count(*) over (partition by p{i}) - 1) / 2.0::double as mid from probs""")
    auc = f"""{SCORES}, ranked as ({' union all '.join(ranks)}),
      areas as (select cls, count(*) filter (where pos) as np, count(*) filter (where not pos) as nn,
        sum(case when pos then mid else 0 end) as rp from ranked group by cls),
      auc as (select sum((rp - np * (np + 1) / 2.0::double) / (np::double * nn) * np) / sum(np) as auc from areas)"""
    out["auc_ovr"] = f"with {auc} select round(auc, 6) as auc from auc"
    out["annotator_eval"] = f"""with {gold} select 'Manual Extraction' as method, round(accuracy, 6) as accuracy,
      round(precision, 6) as precision, round(recall, 6) as recall, round(f1_score, 6) as f1_score,
      cast(null as double) as auc, round({KAPPA}, 6) as kappa, sample_size, unseen_rows from overall"""
    responder = f"""{RESPONSES}, picked as (select * from answers where severity_grade is not null
        order by md5(report_id || '42'), report_id limit 103),
      {metric_ctes("select severity_grade as y, " + response_grade('response') + " as p from picked")}"""
    out["responder_eval"] = f"""with {responder} select 'Responder' as method, round(accuracy, 6) as accuracy,
      round(precision, 6) as precision, round(recall, 6) as recall, round(f1_score, 6) as f1_score,
      cast(null as double) as auc, round({KAPPA}, 6) as kappa, sample_size from overall"""
    scored = f"""{SCORES}, {auc.split(SCORES + ', ')[1]}, guessed as (select y, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as p from probs),
      {metric_ctes("select y, p from guessed")}"""
    result = f"""select method, accuracy, precision, recall, f1_score, auc, kappa, sample_size, fit_order from"""
    out["comparison_table"] = f"""
      with a as (with {scored} select 'Scores' as method, accuracy, precision, recall, f1_score, auc, {KAPPA} as kappa, sample_size from overall, auc),
      b as (with {gold} select 'Manual Extraction' as method, accuracy, precision, recall, f1_score, cast(null as double) as auc, {KAPPA} as kappa, sample_size from overall),
      c as (with {responder} select 'Responder' as method, accuracy, precision, recall, f1_score, cast(null as double) as auc, {KAPPA} as kappa, sample_size from overall)
      select method as "Method", printf('%.4f', accuracy) as "Accuracy", printf('%.4f', precision) as "Precision",
        printf('%.4f', recall) as "Recall", printf('%.4f', f1_score) as "F1-Score",
        coalesce(printf('%.4f', auc), 'N/A') as "AUC-ROC", coalesce(printf('%.4f', kappa), 'N/A') as "Kappa", sample_size as "Sample Size"
      from (select * from a union all select * from b union all select * from c)"""
    out["best_method"] = f"""
      with a as (with {scored} select 'Scores' as method, accuracy from overall),
      b as (with {gold} select 'Manual Extraction' as method, accuracy from overall),
      c as (with {responder} select 'Responder' as method, accuracy from overall)
      select method, round(accuracy, 6) as accuracy from (
        select *, 0 as o from a union all select *, 1 from b union all select *, 2 from c) order by accuracy desc, o limit 1"""
    return out
