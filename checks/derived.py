"""Report tables derived from ``orders``: one SQL text each, valid in Spark and DuckDB."""

# The texts cover every branch of the report rules; FIXTURES.md lists the expected counts.
ULTRASOUND_SQL = """
select 'ped_ultrsndrpt_' || case when o_orderkey % 997 = 0 then 'x' || cast(o_orderkey as string) else 'rptCASE-AB' || cast(10 + o_orderkey % 90 as string) || 'CD-' || cast(10000 + o_orderkey as string) end as report_id,
 case when o_orderkey % 11 = 0 or o_orderkey % 997 = 0 then 'Ultrasound report' else 'Case ID: CASE-AB' || cast(10 + o_orderkey % 90 as string) || 'CD-' || cast(10000 + o_orderkey as string) end || chr(10)
 || case o_orderkey % 3 when 0 then 'Date of exam: ' when 1 then 'Exam Date - ' else 'Date ' end
 || case o_orderkey % 4 when 0 then 'January' when 1 then 'May' when 2 then 'August' else 'December' end || ' ' || cast(1 + o_orderkey % 28 as string) || ', 2023' || chr(10) || chr(10)
 || case when o_orderkey % 7 = 0 then '' else 'CLINICAL INFORMATION: ' || lower(o_orderpriority) || ' pain' || chr(10) || 'for ' || cast(1 + o_orderkey % 5 as string) || ' days' || chr(10) || 'TECHNIQUE NOTE: graded' || chr(10) || chr(10) end
 || case when o_orderkey % 13 = 0 then '' else 'Findings: '
   || case when o_orderkey % 5 = 0 then 'Tip not seen. ' else 'The appendix measures ' || cast(4 + o_orderkey % 12 as string) || '.' || cast(o_orderkey % 10 as string) || ' mm. ' end
   || case when o_orderkey % 4 = 0 then 'Wall is thickened at ' || cast(1 + o_orderkey % 4 as string) || ' mm. ' else '' end
   || case o_orderkey % 6 when 0 then 'Free fluid present. ' when 1 then 'Fat stranding. ' when 2 then 'Hyperechoic fat. ' when 3 then 'Enlarged lymph nodes. ' when 4 then 'An appendicolith [*site 3*] is noted. ' else 'No other change. ' end || chr(10) || chr(10) end
 || case when o_orderkey % 17 = 0 then '' else 'IMPRESSION: ' || case o_orderkey % 10 when 0 then 'Normal appendix.' when 1 then 'Unremarkable study.' when 2 then 'Simple appendicitis.' when 3 then 'Uncomplicated appendicitis.' when 4 then 'Complicated appendicitis.' when 5 then 'Gangrenous appendix.' when 6 then 'Perforated appendix.' when 7 then 'Ruptured appendix with abscess.' when 8 then 'Abnormal perforated appendix.' else 'Indeterminate.' end end as report_text
from orders
"""

OPERATIVE_SQL = """
select 'ped_oprpt_' || case when o_orderkey % 997 = 0 then 'x' || cast(o_orderkey as string) else 'CASE-AB' || cast(10 + o_orderkey % 90 as string) || 'CD-' || cast(10000 + o_orderkey as string) end || '_' || cast(v as string) as report_id,
 case when o_orderkey % 997 = 0 then 'Operative report' else 'Case ID: CASE-AB' || cast(10 + o_orderkey % 90 as string) || 'CD-' || cast(10000 + o_orderkey as string) end || chr(10)
 || case when o_orderkey % 19 = 0 then 'Date: not recorded' else 'Date: 2023-0' || cast(1 + o_orderkey % 9 as string) || '-1' || cast(o_orderkey % 10 as string) end || chr(10)
 || case when o_orderkey % 23 = 0 then '' else 'Surgeon: Dr. S' || cast(o_custkey % 40 as string) || chr(10) end
 || 'Pre-operative diagnosis: suspected appendicitis' || chr(10) || 'ASA CLASS: 2' || chr(10) || chr(10)
 || case when o_orderkey % 29 = 0 then '' else 'Post-operative diagnosis: ' || case (o_orderkey + v) % 8 when 0 then 'Normal appendix' when 1 then 'Simple appendicitis' when 2 then 'Uncomplicated appendicitis' when 3 then 'Complicated perforated appendicitis' when 4 then 'Gangrenous appendicitis' when 5 then 'Ruptured appendix' when 6 then 'Abscess' else 'Mesenteric adenitis' end || chr(10) || chr(10) end
 || case when o_orderkey % 31 = 0 then '' else 'Operative findings: ' || case o_custkey % 6 when 0 then 'perforation with abscess' when 1 then 'gangrenous tip' when 2 then 'purulent fluid' when 3 then 'fibrinous exudate, ruptured base' when 4 then 'contamination of pelvis' else 'inflamed appendix only' end || '.' end as report_text
from orders cross join (select 0 as v union all select 1 as v) d
where o_orderkey % 3 <> 0 and (v = 0 or o_orderkey % 10 = 0)
"""
