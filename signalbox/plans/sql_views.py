"""The derived views of :mod:`signalbox.plans.views` as SQL common table expressions.

They restate the rules independently: regular expressions in backtracking-free RE2 form, running
minima instead of periodic lookups, and so on.
"""

from __future__ import annotations

QUESTIONS = """questions as (
  select md5(cast(doc_id as varchar)) as unique_id, doc_id, text as problem, lang as category, source, n_chars,
         doc_id % 2 = 0 as is_mcq,
         case when doc_id % 2 = 0 then list_value(source, lang, cast(n_chars as varchar), 'none') end as choices,
         case when doc_id % 2 = 0 then cast(doc_id % 4 as integer) end as choice_index_correct,
         cast(null as varchar) as explanation_correct,
         case when doc_id % 2 = 1 then cast(n_chars % 97 as varchar)
              when doc_id % 4 = 0 then source else cast(n_chars as varchar) end as answer_correct
  from documents)"""


def responses(shift: int = 0, name: str = "responses") -> str:
    """Raw responses, one row each; needs ``questions``."""
    return f"""{name} as (
  select q.unique_id, q.doc_id, q.problem, q.category, q.source, q.is_mcq, q.choices, cast(s.i as integer) as response_idx,
         q.plain_gold, case when q.is_mcq then concat('\\boxed{{', q.plain_gold, '}}') else q.plain_gold end as gold, s.h,
         case when s.h <= 3 then concat('work <answer>\\boxed{{', q.plain_gold, '}}</answer>')
              when s.h = 4 then concat('so $', q.plain_gold, '$')
              when s.h = 5 then '<answer>wrong</answer>'
              when s.h = 6 then '<answer>\\boxed{{\\frac{{1}}{{2}}}}</answer>'
              when s.h = 7 then 'no final answer'
              when s.h = 8 then 'Error generating response: timeout'
              else '   ' end as full_response
  from (select *, case when is_mcq then chr(65 + choice_index_correct) else answer_correct end as plain_gold
        from questions) q
  join (select doc_id, i, (doc_id * 7 + i * 3 + {shift}) % 10 as h
        from documents, (values (0), (1), (2), (3)) v(i) where i <= doc_id % 4) s on q.doc_id = s.doc_id)"""


_BOXED = r"\\boxed\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"


def _last(expr: str, pattern: str, group: int = 0) -> str:
    return f"list_extract(regexp_extract_all({expr}, '{pattern}', {group}), -1)"


def _sub(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"


def _normal(expr: str) -> str:
    inner = _sub(f"coalesce({_last(expr, _BOXED)}, {expr})", r"^\\boxed\{([\s\S]*)\}$", r"\1")
    plain = _sub(inner, r"\\text\{([^{}]*)\}", r"\1")
    tight = _sub(plain, r"\\left|\\right|\\,|\\!|\\%|%|\^\{\\circ\}|\^\\circ|°|\$|\s", "")
    value = _sub(_sub(tight, r"\\[dt]frac", r"\\frac"), r"^\\?[A-Za-z][A-Za-z0-9_]*=([^=]+)$", r"\1")
    return (
        f"case when regexp_matches({value}, '^[-+]?[0-9]{{1,3}}(,[0-9]{{3}})+(\\.[0-9]+)?$') "
        f"then replace({value}, ',', '') else {value} end"
    )


_NUMBER = r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
_FRACTION = r"^([-+]?)\\frac\{([-+]?)([0-9]+)\}\{([-+]?)([0-9]+)\}$"
_RATIO = r"^([-+]?)([0-9]+)/([-+]?)([0-9]+)$"


def _group(n: str, pattern: str, number: int) -> str:
    return f"regexp_extract({n}, '{pattern}', {number})"


def _plain(n: str) -> str:
    """Sign, whole part without leading zeros and fraction without trailing zeros, as text."""
    body = f"ltrim({n}, '+-')"
    whole = f"ltrim(split_part({body}, '.', 1), '0')"
    after = f"rtrim(split_part({body}, '.', 2), '0')"
    minus = f"case when starts_with({n}, '-') and {whole} || {after} <> '' then '-' else '' end"
    return f"case when regexp_matches({n}, '{_NUMBER}') then {minus} || {whole} || '.' || {after} end"


def _num(n: str) -> str:
    """Signed numerator over a power of ten or the denominator of :func:`_den`."""
    body = f"ltrim({n}, '+-')"
    after = f"rtrim(split_part({body}, '.', 2), '0')"
    sign = f"case when starts_with({n}, '-') then -1 else 1 end"

    def odd(*signs: str) -> str:
        return f"case when length(replace(concat({', '.join(signs)}), '+', '')) % 2 = 1 then -1 else 1 end"

    fraction = odd(*(_group(n, _FRACTION, i) for i in (1, 2, 4)))
    ratio = odd(*(_group(n, _RATIO, i) for i in (1, 3)))
    return (
        f"case when regexp_matches({n}, '{_NUMBER}') then ({sign}) * try_cast('0' || split_part({body}, '.', 1) || {after} as hugeint) "
        f"when regexp_matches({n}, '{_FRACTION}') then ({fraction}) * try_cast({_group(n, _FRACTION, 3)} as hugeint) "
        f"when regexp_matches({n}, '{_RATIO}') then ({ratio}) * try_cast({_group(n, _RATIO, 2)} as hugeint) end"
    )


def _den(n: str) -> str:
    after = f"rtrim(split_part(ltrim({n}, '+-'), '.', 2), '0')"
    return (
        f"case when regexp_matches({n}, '{_FRACTION}') then try_cast({_group(n, _FRACTION, 5)} as hugeint) "
        f"when regexp_matches({n}, '{_RATIO}') then try_cast({_group(n, _RATIO, 4)} as hugeint) "
        f"else try_cast('1' || repeat('0', length({after})) as hugeint) end"
    )


def _equal_numbers(a: str, b: str) -> str:
    """Numbers of any length by their text; fractions by products, which have to fit 38 digits here."""
    return (
        f"case when regexp_matches({a}, '{_NUMBER}') and regexp_matches({b}, '{_NUMBER}') then ({_plain(a)}) = ({_plain(b)}) "
        f"when ({_den(a)}) <> 0 and ({_den(b)}) <> 0 then ({_num(a)}) * ({_den(b)}) = ({_num(b)}) * ({_den(a)}) end"
    )


def extracted(source: str = "responses", name: str = "extracted") -> str:
    """Adds ``extracted_answer`` to the rows of ``source``."""
    return f"""{name} as (
  select * exclude (scope, tag), coalesce({_last('scope', _BOXED)}, {_last('scope', '[$][^' + chr(92) + 'n]*?[$]')}, tag,
         'No answer found in formatted output') as extracted_answer
  from (select *, coalesce(tag, full_response) as scope
        from (select *, trim({_last('full_response', '(?s)<answer>(.*?)</answer>', 1)}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) as tag
              from {source})))"""


def graded(source: str = "responses", name: str = "graded") -> str:
    """Adds ``extracted_answer`` and ``is_correct`` to the rows of ``source``."""
    return f"""{extracted(source, name + '_extracted')},
{name}_normal as (
  select *, {_normal('gold')} as ng, {_normal('extracted_answer')} as na from {name}_extracted),
{name} as (
  select * exclude (ng, na), coalesce(ng <> '' and na <> '' and (ng = na or coalesce({_equal_numbers('ng', 'na')}, false)), false) as is_correct
  from {name}_normal)"""


def judged(source: str = "graded", name: str = "judged") -> str:
    """The fixed rule that stands for a judge; needs graded rows."""
    return f"""{name} as (
  select * exclude (is_correct),
         case when is_correct then 'math_verify' when h in (5, 6) then 'llm_judge' else 'regex_fallback' end as extraction_method,
         case when not is_correct and h in (5, 6) then concat('judged: ', extracted_answer) end as judge_explanation,
         case when is_correct then true when h in (5, 6) then doc_id % 3 = 0 else false end as is_correct
  from {source})"""


PREDICTIONS = """predictions as (
  select d.doc_id, md5(cast(d.doc_id as varchar)) as unique_id, d.text as prompt,
         cast(d.n_chars % 1024 as double) / 1024 as think_probability,
         1 - cast(d.n_chars % 1024 as double) / 1024 as no_think_probability,
         cast(d.doc_id % 512 as double) / 512 as difficulty_score,
         case when l.quality = 1 then 'think' when l.quality = 0 then 'no_think' end as label,
         case when d.doc_id % 11 <> 0 then cast(d.n_chars % 50 as double) / 2 end as think_score,
         case when d.doc_id % 13 <> 0 then cast(d.doc_id % 50 as double) / 2 end as no_think_score
  from documents d left join labels l on d.doc_id = l.doc_id)"""

CHUNKS = """chunks as (
  select user_id as request_id, event_id as seq,
         case when event_type <> 'error' then concat(event_type, ' ') end as content,
         case when event_type in ('view', 'error') then concat('r', cast(event_id as varchar), ' ') end as reasoning
  from events)"""

SCORES = """scores as (
  select doc_id, cast(n_chars % 1024 as double) / 1024 as reasoning_score,
         cast(doc_id % 512 as double) / 512 as difficulty_score
  from documents)"""

STATISTICS = """statistics as (
  select unique_id, count(*) as total_responses, count(*) filter (is_correct) as correct_responses,
         count(*) filter (is_correct) / count(*) as accuracy,
         count(*) filter (extraction_method = 'math_verify') as math_verify_count,
         count(*) filter (extraction_method = 'llm_judge') as llm_judge_count,
         count(*) filter (extraction_method = 'regex_fallback') as regex_fallback_count,
         coalesce(count(*) filter (extraction_method = 'math_verify' and is_correct)
                  / nullif(count(*) filter (extraction_method = 'math_verify'), 0), 0) as math_verify_accuracy,
         coalesce(count(*) filter (extraction_method = 'llm_judge' and is_correct)
                  / nullif(count(*) filter (extraction_method = 'llm_judge'), 0), 0) as llm_judge_accuracy,
         coalesce(count(*) filter (extraction_method = 'regex_fallback' and is_correct)
                  / nullif(count(*) filter (extraction_method = 'regex_fallback'), 0), 0) as regex_fallback_accuracy
  from judged group by unique_id)"""

TURN_PAIRS = """pairs as (
  select conv_id, pair_id, max(text) filter (role = 'user') as user_text,
         coalesce(arg_max(text, turn) filter (role = 'assistant'), '') as assistant_text
  from (select *, count(*) filter (role = 'user')
               over (partition by conv_id order by turn rows between unbounded preceding and current row) as pair_id
        from conversations)
  where pair_id > 0 and role in ('user', 'assistant') group by conv_id, pair_id)"""


def with_views(*views: str) -> str:
    return "with " + ",\n".join(views) + "\n"


RAW = (QUESTIONS, responses())
GRADED = (*RAW, graded())
JUDGED = (*GRADED, judged())
