"""Final-answer extraction and equality as column expressions.

Both run on whole responses inside the JVM, in time linear in their length: tags are found by
splitting, and the brace pattern is possessive, because its backtracking form exhausts the regex
stack on long answers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbox.functions import algebra
from signalbox.functions.text import bind, last_match, strip

# What counts as a final answer and what is reported when there is none.
OPEN_TAG, CLOSE_TAG = "<answer>", "</answer>"
BOXED_PATTERN = r"\\boxed\{(?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+\}"
DOLLAR_PATTERN = r"\$[^\n$]*+\$"
NOT_FOUND = "No answer found in formatted output"
EXTRACTION_FAILED = "Extraction failed"


def last_tagged(text: Column) -> Column:
    """Stripped content of the last answer tag, null when there is none.

    A tag runs from the first opening after the previous end to the next end. So of the pieces that
    an end closes, the last with an opening holds the last tag, from its first opening on.
    """

    def after_opening(piece: Column) -> Column:
        return F.substr(piece, F.locate(OPEN_TAG, piece) + len(OPEN_TAG))

    def closed(pieces: Column) -> Column:
        opened = F.filter(F.slice(pieces, 1, F.size(pieces) - 1), lambda piece: piece.contains(OPEN_TAG))
        return bind(F.try_element_at(opened, F.lit(-1)), after_opening)

    return strip(F.when(text.contains(CLOSE_TAG), bind(F.split(text, CLOSE_TAG, -1), closed)))


def last_boxed(text: Column) -> Column:
    """Last boxed expression with its wrapper, braces balanced to two inner levels."""
    return F.when(text.contains("\\boxed{"), last_match(text, BOXED_PATTERN))


def last_dollar(text: Column) -> Column:
    """Last inline-math run on one line, dollars kept."""
    return F.when(text.contains("$"), last_match(text, DOLLAR_PATTERN))


def extract_answer(text: Column) -> Column:
    """Answer of one response: inside the last tag if any, else in the whole text.

    Boxed beats dollar math; a tag without either yields the tag text itself.
    """

    def search(tagged: Column) -> Column:
        return bind(
            F.coalesce(tagged, text),
            lambda scope: F.coalesce(
                last_boxed(scope),
                last_dollar(scope),
                F.when(tagged.isNotNull(), tagged),
                F.lit(NOT_FOUND),
            ),
        )

    return bind(last_tagged(text), search)


def extraction_failed(extracted: Column) -> Column:
    return extracted.isNull() | (extracted == NOT_FOUND) | (strip(extracted) == "")


def _unwrapped(answer: Column) -> Column:
    """Content of the last box, or the answer itself."""
    boxed = F.coalesce(last_boxed(answer), answer)
    return F.when(
        boxed.startswith("\\boxed{"), F.regexp_replace(boxed, r"^\\boxed\{([\s\S]*)\}$", "$1")
    ).otherwise(boxed)


def _respelled(text: Column) -> Column:
    plain = F.regexp_replace(text, r"\\text\{([^{}]*)\}", "$1")
    tight = F.regexp_replace(
        plain, r"\\left|\\right|\\,|\\!|\\%|%|\^\{\\circ\}|\^\\circ|°|\$|\s", ""
    )
    frac = F.regexp_replace(tight, r"\\[dt]frac", r"\\frac")
    value = F.regexp_replace(frac, r"^\\?[A-Za-z][A-Za-z0-9_]*=([^=]+)$", "$1")
    return bind(
        value,
        lambda v: F.when(
            v.rlike(r"^[-+]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"), F.replace(v, F.lit(","))
        ).otherwise(v),
    )


def normalize_answer(answer: Column) -> Column:
    """Canonical spelling of a short final answer.

    Unwraps the last box and text macros, drops math delimiters, spacing, percent and degree
    marks, keeps the right side of ``name = value``, unifies fraction macros and removes
    thousands commas. Plain words and numbers, which no rule touches, skip the rules.
    """
    return bind(
        _unwrapped(answer),
        lambda inner: F.when(inner.rlike(r"^[A-Za-z0-9.+-]*$"), inner).otherwise(_respelled(inner)),
    )


_NUMBER = r"^[-+]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)$"
_FRACTION = r"^([-+]?)\\frac\{([-+]?)([0-9]++)\}\{([-+]?)([0-9]++)\}$"
_RATIO = r"^([-+]?)([0-9]++)/([-+]?)([0-9]++)$"
#: Digits of a limb, and digits a decimal holds.
_LIMB, _DECIMAL = 6, 38


def _quotient(norm: Column) -> Column:
    """Sign and digits of numerator and denominator of a number or fraction of any length, null for anything else."""

    def digits(text: Column) -> Column:
        trimmed = F.ltrim(text, F.lit("0"))
        return F.when(trimmed == "", "0").otherwise(trimmed)

    def parts(minus: Column, top: Column, bottom: Column) -> Column:
        return F.struct(
            (minus & (digits(top) != "0")).alias("minus"), digits(top).alias("top"), digits(bottom).alias("bottom"))

    def group(pattern: str, number: int) -> Column:
        return F.regexp_extract(norm, pattern, number)

    def odd_minus(*signs: Column) -> Column:
        return F.length(F.translate(F.concat(*signs), "+", "")) % 2 == 1

    def decimal(plain: Column) -> Column:
        after = F.rtrim(F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise(""), F.lit("0"))
        whole = F.substring_index(plain, ".", 1)
        return parts(norm.startswith("-"), F.concat(whole, after), F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(after))))

    return (
        F.when(norm.rlike(_NUMBER), bind(F.ltrim(norm, F.lit("+-")), decimal))
        .when(norm.rlike(_RATIO), parts(odd_minus(group(_RATIO, 1), group(_RATIO, 3)), group(_RATIO, 2), group(_RATIO, 4)))
        .when(norm.rlike(_FRACTION), parts(
            odd_minus(group(_FRACTION, 1), group(_FRACTION, 2), group(_FRACTION, 4)), group(_FRACTION, 3), group(_FRACTION, 5)))
    )


def _limbs(digits: Column) -> Column:
    """The digits in groups of six, the lowest first."""
    count = F.ceil(F.length(digits) / _LIMB).cast("int")
    padded = F.lpad(digits, count * _LIMB, "0")
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.substr(padded, (count - 1 - i) * _LIMB + 1, F.lit(_LIMB)).cast("long"))


def _long_product(left: Column, right: Column) -> Column:
    """Product of two digit texts of any length, as its limbs, without leading zero limbs."""

    def column_sums(a: Column, b: Column) -> Column:
        def at(k: Column) -> Column:
            low, high = F.greatest(F.lit(0), k - F.size(b) + 1), F.least(k, F.size(a) - 1)
            return F.aggregate(F.sequence(low, high), F.lit(0).cast("long"), lambda total, i: total + F.get(a, i) * F.get(b, k - i))

        return F.transform(F.sequence(F.lit(0), F.size(a) + F.size(b) - 2), at)

    def carried(sums: Column) -> Column:
        base = 10**_LIMB
        start = F.struct(F.array().cast("array<long>").alias("limbs"), F.lit(0).cast("long").alias("carry"))

        def step(state: Column, value: Column) -> Column:
            total = state["carry"] + value
            return F.struct(
                F.concat(state["limbs"], F.array(total % base)).alias("limbs"), F.floor(total / base).cast("long").alias("carry"))

        done = F.aggregate(F.concat(sums, F.array_repeat(F.lit(0).cast("long"), 4)), start, step)
        return F.rtrim(F.array_join(F.transform(done["limbs"], lambda x: x.cast("string")), ","), F.lit(",0"))

    sums = bind(_limbs(left), lambda a: bind(_limbs(right), lambda b: column_sums(a, b)))
    return bind(sums, carried)


def _same_number(left: Column, right: Column) -> Column:
    def products(a: Column, b: Column) -> Column:
        longest = F.greatest(F.length(a["top"]) + F.length(b["bottom"]), F.length(b["top"]) + F.length(a["bottom"]))
        short = (
            a["top"].cast("decimal(38,0)") * b["bottom"].cast("decimal(38,0)")
            == b["top"].cast("decimal(38,0)") * a["bottom"].cast("decimal(38,0)")
        )
        exact = _long_product(a["top"], b["bottom"]) == _long_product(b["top"], a["bottom"])
        return F.when(longest <= _DECIMAL, short).otherwise(exact)

    def cross(a: Column, b: Column) -> Column:
        spelled = (a["top"] == b["top"]) & (a["bottom"] == b["bottom"])
        defined = (a["bottom"] != "0") & (b["bottom"] != "0") & (a["minus"] == b["minus"])
        # Decimals of equal scale, and so all whole numbers, are equal only if spelled alike.
        return F.when(~defined, F.lit(False)).when(spelled, F.lit(True)).when(
            a["bottom"] == b["bottom"], F.lit(False)).otherwise(products(a, b))

    equal = bind(_quotient(left), lambda a: bind(_quotient(right), lambda b: cross(a, b)))
    digits = left.rlike(r"[0-9]") & right.rlike(r"[0-9]")
    return F.when(digits, F.coalesce(equal, F.lit(False))).otherwise(F.lit(False))


def _same_value(left: Column, right: Column) -> Column:
    return (left != "") & (right != "") & ((left == right) | _same_number(left, right))


def answers_equal(expected: Column, given: Column) -> Column:
    """Equality after normalisation: same spelling or same exact number.

    Arithmetic and equations are "not equal" here; :func:`answers_match` compares them too.
    """
    return F.coalesce(
        bind(
            normalize_answer(expected),
            lambda left: bind(normalize_answer(given), lambda right: _same_value(left, right)),
        ),
        F.lit(False),
    )


def _operands(expected: Column, given: Column) -> tuple[Column, Column, Column]:
    """Both answers without their boxes, and whether algebra may tell more than their spelling."""
    left, right = _unwrapped(expected), _unwrapped(given)
    return left, right, algebra.may_compare(left, right)


def answers_match(expected: Column, given: Column) -> Column:
    """:func:`answers_equal`, or equal as arithmetic, linear expressions or systems of linear equations.

    Only pairs that look like algebra reach Python, and only pairs that are not equal there are normalised
    and compared by spelling. Not for use inside higher-order functions.
    """
    left, right, open_ = _operands(expected, given)
    solved = algebra.same_values(F.when(open_, left), F.when(open_, right))
    return F.coalesce(solved, F.lit(False)) | answers_equal(expected, given)


def each_matches(expected: Column, given: Column) -> Column:
    """For an array of answers, whether each equals ``expected`` as algebra; null where none looks like it."""
    pairs = F.transform(given, lambda g: bind(g, lambda x: F.when(_operands(expected, x)[2], _unwrapped(x))))
    some = F.exists(pairs, lambda x: x.isNotNull())
    return algebra.same_values_each(F.when(some, _unwrapped(expected)), F.when(some, pairs))


def choice_letter(index: Column) -> Column:
    """0 -> A, 1 -> B, ..."""
    return F.char(index + F.lit(65))


def gold_answer(is_mcq: Column, choice_index: Column, answer: Column) -> Column:
    """Expected answer: the boxed letter for multiple choice, else the stored text."""
    letter = F.concat(F.lit("\\boxed{"), choice_letter(choice_index), F.lit("}"))
    return F.when(F.coalesce(is_mcq, F.lit(False)), letter).otherwise(answer)
