"""Prompt rendering as column expressions.

The wording of a prompt is a parameter: a template is plain text with ``{{ name }}`` slots, cut
once on the driver into literals and columns. The defaults below are our own wording around the
fixed layout (answer tags, the question block, the verdict fields). To reproduce prompts rendered
elsewhere byte for byte, pass that text as the template.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.answers import choice_letter

MAX_CHOICES = 26
_SLOT = re.compile(r"\{\{\s*(\w+)\s*\}\}")

MATH_TEMPLATE = """
The last line of your reply is <answer>\\boxed{result}</answer>.

User: {{ question }}
Assistant:
"""

CHOICE_TEMPLATE = """
The last line of your reply is <answer>\\boxed{letter of your option}</answer>.

User: {{ question }}
Options:
{{ options }}
Assistant:
"""

OPEN_ENDED_TEMPLATE = """
Reply to this question.

Question: {{ question }}
"""

SUBJECTIVE_TEMPLATE = """
Reply to this question in detail.

Question: {{ question }}
"""

JUDGE_TEMPLATE = """
Compare the two answers and return JSON: "is_match" (true or false), "final_answer", "explanation".

Question: {{ question }}
Answer: {{ answer }}
Correct Answer: {{ correct_answer }}
"""

CHOICE_JUDGE_TEMPLATE = """
Compare the chosen options and return JSON: "is_match" (true or false), "final_answer", "explanation".

Question: {{ question }}
Choices:
{{ options }}
Answer: {{ answer }}
Correct Answer: {{ correct_answer }}
"""


def render(template: str, slots: Mapping[str, Column]) -> Column:
    """Fill a template; one trailing line break of the template is dropped."""
    text = template[:-1] if template.endswith("\n") else template
    pieces, end = [], 0
    for found in _SLOT.finditer(text):
        pieces += [F.lit(text[end : found.start()]), F.coalesce(slots[found[1]], F.lit(""))]
        end = found.end()
    return F.concat(*pieces, F.lit(text[end:]))


def option_block(lines: Column) -> Column:
    """Each option on its own line, set off by the line breaks of a template loop."""
    return F.concat(
        F.array_join(F.transform(lines, lambda line: F.concat(F.lit("\n"), line, F.lit("\n"))), ""),
    )


def format_choices(choices: Column) -> Column:
    """``A. text`` lines; more options than letters stop the job."""
    lettered = F.transform(choices, lambda text, i: F.concat(choice_letter(i), F.lit(". "), text))
    too_many = F.raise_error(F.lit(f"more than {MAX_CHOICES} choices")).cast("array<string>")
    return F.when(F.size(choices) > MAX_CHOICES, too_many).otherwise(lettered)


def is_mcq(choices: Column) -> Column:
    """Multiple choice means the list exists, even when it is empty."""
    return choices.isNotNull()


def generation_prompt(
    question: Column,
    choices: Column,
    open_ended: bool = False,
    math_template: str = MATH_TEMPLATE,
    choice_template: str = CHOICE_TEMPLATE,
    open_template: str = OPEN_ENDED_TEMPLATE,
) -> Column:
    """Multiple-choice prompt for a non-empty choice list, else the math or open-ended one."""
    with_options = render(
        choice_template, {"question": question, "options": option_block(format_choices(choices))}
    )
    plain = render(open_template if open_ended else math_template, {"question": question})
    return F.when(F.coalesce(F.size(choices), F.lit(0)) > 0, with_options).otherwise(plain)


def subjective_prompt(question: Column, template: str = SUBJECTIVE_TEMPLATE) -> Column:
    return render(template, {"question": question})


def judge_prompt(
    question: Column,
    answer: Column,
    correct_answer: Column,
    choices: Column,
    mcq: Column,
    compat: bool = False,
    template: str = JUDGE_TEMPLATE,
    choice_template: str = CHOICE_JUDGE_TEMPLATE,
) -> Column:
    """Judge prompt. ``compat`` letters the options twice (``A: A. text``), else once."""
    listed = F.coalesce(choices, F.array().cast("array<string>"))
    shown = format_choices(listed) if compat else listed
    lines = F.transform(shown, lambda text, i: F.concat(choice_letter(i), F.lit(": "), text))
    shared = {"question": question, "answer": answer, "correct_answer": correct_answer}
    return F.when(
        F.coalesce(mcq, F.lit(False)),
        render(choice_template, {**shared, "options": option_block(lines)}),
    ).otherwise(render(template, shared))


def with_prompts(questions: DataFrame, question_col: str = "problem", **templates) -> DataFrame:
    """Add ``is_mcq`` and ``prompt``."""
    choices = F.col("choices")
    return questions.withColumn("is_mcq", is_mcq(choices)).withColumn(
        "prompt", generation_prompt(F.col(question_col), choices, **templates)
    )
