"""Answer extraction, normalisation and grading as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Answer patterns and limits.
OPTION_PATTERN = r"(?i)final answer\s*:\s*([A-Za-z0-9]+)"
LABELLED_PATTERN = r"(?id)(?:final answer|answer)\s*:\s*(.+)"
DISPLAY_PATTERN = r"(?s)\\\[(.*?)\\\]"
NUMERIC_PATTERN = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+|\d+/\d+|\\d?frac\{[+-]?\d+\}\{[+-]?\d+\})$"
MAX_ANSWER_CHARS = 200
# Fractions are reduced in BIGINT, longer ones in DECIMAL(38); those beyond both in Python.
SHORT_DIGITS, MAX_FRACTION_DIGITS = 18, 32
STEPS_PER_DIGIT = 5
# Digits of one piece of a number that is multiplied piece by piece.
PIECE_DIGITS = 6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


# Printable ASCII without a backslash and nothing to trim at its ends: no wrapper to take off.
TIDY = r"^[!-#%-\[\]-~](?:[ -\[\]-~]*[!-#%--/-\[\]-~])?$"
NUMERIC_START = r"^[+-]?\.?[0-9]"


def parse_option_answer(text: Column, options: Column) -> Column:
    """Return the first labelled option when it names a valid option, else null."""
    letter = F.upper(F.regexp_extract(text, OPTION_PATTERN, 1))
    return F.when(F.array_contains(F.map_keys(options), letter), letter)


def _digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def _number(text: Column, kind: str) -> Column:
    return F.regexp_replace(text, r"[+\s]", "").cast(kind)


def _unreduced(num: Column, den: Column) -> Column:
    """Render a fraction too long to reduce by its digits; null for a zero denominator."""
    top, bottom = (_integer_text(F.regexp_replace(x, r"\s", "")) for x in (num, den))
    return F.when(bottom != "0", F.concat(top, F.lit("/"), bottom))


def _integer_text(text: Column) -> Column:
    digits = F.regexp_replace(text, r"^[+-]?0*", "")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    return F.when(digits == "", "0").otherwise(F.concat(sign, digits))


def reduced_fraction(num: Column, den: Column, kind: str = "decimal(38,0)") -> Column:
    """Render num/den in lowest terms; null for a zero denominator or missing parts."""
    zero = F.lit(0).cast(kind)
    pair = F.struct(num.alias("n"), den.alias("d"))

    def with_gcd(v: Column) -> Column:
        state = F.struct(F.abs(v["n"]).alias("x"), F.abs(v["d"]).alias("y"))
        # Euclid's rule needs fewer than five steps per digit of the smaller number.
        digits = F.least(F.length(v["n"].cast("string")), F.length(v["d"].cast("string")))
        gcd = F.aggregate(
            F.sequence(F.lit(1), F.lit(STEPS_PER_DIGIT) * digits + 2),
            state,
            lambda s, _: F.when(s["y"] == zero, s).otherwise(
                F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).cast(kind).alias("y"))
            ),
            lambda s: s["x"],
        )
        return F.struct(v["n"].alias("n"), v["d"].alias("d"), gcd.alias("g"))

    def part(value: Column, gcd: Column) -> Column:
        if kind == "bigint":
            return F.call_function("div", F.abs(value), gcd).cast("string")
        return F.try_divide(F.abs(value), gcd).cast(kind).cast("string")

    def text(v: Column) -> Column:
        top, bottom = part(v["n"], v["g"]), part(v["d"], v["g"])
        negative = (v["n"] != zero) & ((v["n"] < zero) != (v["d"] < zero))
        whole = F.concat(F.when(negative, "-").otherwise(""), top)
        return F.when(v["d"] != zero, F.when(bottom == "1", whole).otherwise(
            F.concat(whole, F.lit("/"), bottom)
        ))

    return F.when(den != zero, let(let(pair, with_gcd), text))


def _fraction(num: Column, den: Column) -> Column:
    """Reduce a fraction given as text, in the narrowest type that holds it."""

    def reduce(v: Column) -> Column:
        size = F.greatest(_digits(v["n"]), _digits(v["d"]))
        return (
            F.when(size <= SHORT_DIGITS, reduced_fraction(
                _number(v["n"], "bigint"), _number(v["d"], "bigint"), "bigint"))
            .when(size <= MAX_FRACTION_DIGITS, reduced_fraction(
                _number(v["n"], "decimal(38,0)"), _number(v["d"], "decimal(38,0)")))
            .otherwise(_unreduced(v["n"], v["d"]))
        )

    return let(F.struct(num.alias("n"), den.alias("d")), reduce)


# A normal form whose fraction was too long to reduce.
LONG_FRACTION = (
    rf"^-?(?:[0-9]{{{MAX_FRACTION_DIGITS + 1},}}/-?[0-9]+|[0-9]+/-?[0-9]{{{MAX_FRACTION_DIGITS + 1},}})$"
)


def _reduce_long(values: Column) -> Column:
    """Reduce fractions of any length in Python; self-contained for the executors."""

    def reduce(texts: pa.Array) -> pa.Array:
        import math
        import re
        import sys

        sys.set_int_max_str_digits(0)
        fraction = re.compile(r"(-?[0-9]+)/(-?[0-9]+)")

        def lowest(text: str | None) -> str | None:
            parts = fraction.fullmatch(text) if text else None
            if not parts:
                return text
            top, bottom = int(parts[1]), int(parts[2])
            divisor = math.gcd(top, bottom) * (1 if bottom > 0 else -1)
            return f"{top // divisor}" + (f"/{bottom // divisor}" if bottom != divisor else "")

        return pa.array([lowest(x) for x in texts.to_pylist()], pa.string())

    reduce.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(reduce, "string")(values)


# The shapes of numeric answers.
SHORT_FRACTION = r"^\\frac\s*([+-]?\d+)\s*([+-]?\d+)$"
BRACED_FRACTION = r"^\\frac\{([^{}]+)\}\{([^{}]+)\}$"
# Plain integers are their own normal form.
PLAIN_INTEGER = r"^(?:0|-?[1-9][0-9]*)$"
SINGLE_SPACED = r"^[!-~]+(?: [!-~]+)*$"
BRACED_INTEGERS = r"^\\frac\{\s*[+-]?\d+\s*\}\{\s*[+-]?\d+\s*\}$"


def _canonical(value: Column) -> Column:
    """Classify an unwrapped answer once, then render its canonical form."""
    compact = F.replace(value, F.lit(" "), F.lit(""))
    number = (
        F.when(compact.rlike(r"^[+-]?\d+$"), "integer")
        .when(compact.rlike(r"^[+-]?\d+/\d+$"), "slash")
        .when(compact.rlike(r"^[+-]?(?:\d+\.\d*|\.\d+)$"), "decimal")
        .when(F.length(value) <= MAX_ANSWER_CHARS, "text")
    )
    shape = (
        F.when(compact.rlike(NUMERIC_START), number)
        .when(
            value.startswith(r"\frac"),
            F.when(value.rlike(SHORT_FRACTION), "short")
            .when(value.rlike(BRACED_INTEGERS), "braced")
            .when(value.rlike(BRACED_FRACTION), "ambiguous")
            .when(F.length(value) <= MAX_ANSWER_CHARS, "text"),
        )
        .when((value != "") & (F.length(value) <= MAX_ANSWER_CHARS), "text")
    )

    def parts(v: Column) -> Column:
        text, bare = v["text"], v["bare"]

        def side(index: int, slash: Column, decimal: Column) -> Column:
            return (
                F.when(v["shape"] == "short", F.regexp_extract(text, SHORT_FRACTION, index))
                .when(v["shape"] == "braced", F.regexp_extract(text, BRACED_FRACTION, index))
                .when(v["shape"] == "slash", slash)
                .when(v["shape"] == "decimal", decimal)
            )

        places = F.length(F.substring_index(bare, ".", -1))
        scale = F.rpad(F.lit("1"), places + 1, F.lit("0"))
        top = side(1, F.substring_index(bare, "/", 1), F.replace(bare, F.lit("."), F.lit("")))
        bottom = side(2, F.substring_index(bare, "/", -1), scale)
        return (
            F.when(v["shape"] == "integer", _integer_text(bare))
            .when(v["shape"] == "text", F.lower(F.when(text.rlike(SINGLE_SPACED), text).otherwise(
                strip(F.regexp_replace(text, r"\s+", " ")))))
            .otherwise(_fraction(top, bottom))
        )

    return let(
        F.struct(value.alias("text"), compact.alias("bare"), shape.alias("shape")), parts
    )


def _unwrap(text: Column) -> Column:
    wrapped = text.startswith(r"\text{") | text.startswith(r"\mathrm{")
    inner = F.regexp_replace(text, r"^\\(?:text|mathrm)\{(.+)\}$", "$1")
    return F.when(wrapped, inner).otherwise(text)


def _normalize(value: Column) -> Column:
    """Return the normal form of an answer, long fractions with their digits as they are."""
    line = F.rtrim(strip(F.substring_index(value, "\n", 1)), F.lit("."))
    bare = F.btrim(strip(line), F.lit("$ "))
    plain = F.replace(bare, F.lit(r"\dfrac"), F.lit(r"\frac"))
    plain = F.replace(F.replace(plain, F.lit(r"\,"), F.lit("")), F.lit(r"\!"), F.lit(""))
    plain = F.when(value.rlike(TIDY), value).otherwise(strip(let(plain, _unwrap)))
    return F.when(value.rlike(PLAIN_INTEGER), value).otherwise(let(plain, _canonical))


def normalize_answer(value: Column) -> Column:
    """Return the canonical exact-match form of an answer, or null when ambiguous.

    Fractions of any length come in lowest terms; only those beyond ``MAX_FRACTION_DIGITS`` leave
    the JVM.
    """
    long = F.length(value) > MAX_FRACTION_DIGITS
    return F.when(long, _reduce_long(F.when(long, _normalize(value)))).otherwise(_normalize(value))


def _in_python(text: Column, kind: str, what: str) -> Column:
    """Read texts in Python, one Arrow batch at a time; self-contained for the executors.

    Matching braces and exact fractions of any length take one walk over a text there, where
    column expressions would read it again for each box.
    """
    patterns = (LABELLED_PATTERN, DISPLAY_PATTERN, NUMERIC_PATTERN, SHORT_FRACTION, BRACED_FRACTION)
    spaces, most = WHITE_SPACE, MAX_ANSWER_CHARS

    def read(texts: pa.Array) -> pa.Array:
        import math
        import re
        import sys

        sys.set_int_max_str_digits(0)
        token = re.compile(r"\\boxed\{|[{}]")
        # The flags of the JVM's patterns, as Python has them.
        labelled = re.compile(patterns[0].removeprefix("(?id)"), re.IGNORECASE | re.ASCII)
        display, numeric, short, braced = (re.compile(p) for p in patterns[1:])
        slash = re.compile(r"([+-]?[0-9]+)(?:/([0-9]+))?")
        point = re.compile(r"([+-]?[0-9]*)\.([0-9]*)")
        wrapper = re.compile(r"\\(?:text|mathrm)\{(.+)\}")
        signed = re.compile(r"\s*[+-]?[0-9]+\s*")
        blank = re.compile(r"\s+")

        def boxes(text: str) -> list[str]:
            open_braces, found = [], []
            for m in token.finditer(text):
                if m[0] != "}":
                    open_braces.append(m.end() if len(m[0]) > 1 else None)
                elif open_braces and (start := open_braces.pop()) is not None:
                    found.append((start, text[start : m.start()]))
            return [content for _, content in sorted(found)]

        def lowest(top: str, bottom: str) -> str | None:
            n, d = int(top), int(bottom)
            if d == 0:
                return None
            divisor = math.gcd(n, d) * (1 if d > 0 else -1)
            return f"{n // divisor}" + (f"/{d // divisor}" if d != divisor else "")

        def normal(value: str) -> str | None:
            bare = value.partition("\n")[0].strip(spaces).rstrip(".").strip(spaces).strip("$ ")
            for old, new in (("\\dfrac", "\\frac"), ("\\,", ""), ("\\!", "")):
                bare = bare.replace(old, new)
            inner = wrapper.fullmatch(bare)
            bare = (inner[1] if inner else bare).strip(spaces)
            if m := short.search(bare):
                return lowest(m[1], m[2])
            if m := braced.search(bare):
                return lowest(m[1], m[2]) if signed.fullmatch(m[1]) and signed.fullmatch(m[2]) else None
            compact = bare.replace(" ", "")
            if m := slash.fullmatch(compact):
                return lowest(m[1], m[2] or "1")
            if (m := point.fullmatch(compact)) and (m[1].strip("+-") or m[2]):
                return lowest(m[1] + m[2], "1" + "0" * len(m[2]))
            return blank.sub(" ", bare).strip(spaces).lower() if bare and len(bare) <= most else None

        def shown(text: str) -> list[str]:
            last = display.findall(text)[-1:]
            if not last:
                return []
            left, equals, right = last[0].strip(spaces).partition("=")
            if not equals:
                right = left
            elif "=" in right or not left.strip(spaces):
                return []
            return [right] if numeric.search(right.replace(" ", "")) else []

        def answer(text: str) -> str | None:
            found = boxes(text) if "\\boxed{" in text else []
            found = found or labelled.findall(text) or shown(text)
            values = {v for v in map(normal, found) if v is not None}
            return values.pop() if len(values) == 1 else None

        if what == "answer":
            return pa.array([None if t is None else answer(t) for t in texts.to_pylist()], pa.string())
        return pa.array([boxes(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

    read.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, kind)(text)


def boxed_answers(text: Column) -> Column:
    """Return the contents of all balanced boxes, boxes inside boxes included, at any depth."""
    return _in_python(F.when(F.contains(text, F.lit(r"\boxed{")), text), "array<string>", "boxes")


def extract_final_answer(text: Column) -> Column:
    """Return the single answer a text commits to: boxed, then labelled, then display maths.

    Null where the text commits to none or to several. Texts without any of the three stay in
    the JVM.
    """
    marked = (
        F.contains(text, F.lit(r"\boxed{")) | F.contains(text, F.lit(r"\["))
        | F.contains(F.lower(text), F.lit("answer"))
    )
    return _in_python(F.when(marked, text), "string", "answer")


def _pieces(digits: Column) -> Column:
    """Cut a number's digits into pieces of ``PIECE_DIGITS``, the lowest first."""
    width = F.ceil(F.length(digits) / PIECE_DIGITS) * PIECE_DIGITS
    padded = F.lpad(digits, width, F.lit("0"))
    cut = F.regexp_extract_all(padded, F.lit(rf"[0-9]{{{PIECE_DIGITS}}}"), 0)
    return F.reverse(F.transform(cut, lambda x: x.cast("bigint")))


def _product(a: Column, b: Column, size: Column) -> Column:
    """Multiply two numbers in pieces; carries are left in the pieces."""

    def piece(k: Column) -> Column:
        low, high = F.greatest(F.lit(0), k - F.size(b) + 1), F.least(k, F.size(a) - 1)
        terms = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(terms, F.lit(0).cast("bigint"), lambda s, i: s + F.get(a, i) * F.get(b, k - i))

    return F.transform(F.sequence(F.lit(0), size), piece)


def _equal_fractions(left: Column, right: Column) -> Column:
    """Compare two fractions of any length by multiplying across, piece by piece."""

    def side(text: Column, part: int) -> Column:
        digits = F.regexp_replace(F.substring_index(text, "/", part), "-", "")
        return _pieces(F.when(F.lit(part == -1) & ~F.contains(text, F.lit("/")), "1").otherwise(digits))

    def negative(text: Column) -> Column:
        signs = F.length(text) - F.length(F.replace(text, F.lit("-"), F.lit("")))
        return (signs % 2 == 1) & ~text.rlike("^-?0*(?:/|$)")

    numbers = F.struct(
        side(left, 1).alias("a"), side(left, -1).alias("b"), side(right, 1).alias("c"), side(right, -1).alias("d")
    )

    def equal(v: Column) -> Column:
        size = F.size(v["a"]) + F.size(v["b"]) + F.size(v["c"]) + F.size(v["d"])
        gap = F.zip_with(_product(v["a"], v["d"], size), _product(v["b"], v["c"], size), lambda x, y: x - y)
        base = F.lit(10**PIECE_DIGITS)
        # The difference is zero if every piece, with what is carried into it, ends in zeros.
        start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit(True).alias("same"))
        step = lambda s, x: F.struct(
            F.call_function("div", s["carry"] + x, base).alias("carry"),
            (s["same"] & ((s["carry"] + x) % base == 0)).alias("same"),
        )
        return F.aggregate(gap, start, step, lambda s: s["same"] & (s["carry"] == 0))

    return (negative(left) == negative(right)) & let(numbers, equal)


def grade_normalized(predicted: Column, gold: Column) -> Column:
    """Grade two normalised answers.

    Unequal numbers are incorrect, and so are two different names. Fractions that are not in lowest
    terms are compared by multiplying across.
    """
    number, name = r"^-?[0-9]+(?:/-?[0-9]+)?$", r"^[a-z]+$"
    # Normal forms have no other white space.
    same = (predicted == gold) | (
        F.replace(predicted, F.lit(" "), F.lit("")) == F.replace(gold, F.lit(" "), F.lit(""))
    )
    size = F.greatest(F.length(predicted), F.length(gold))
    long = (size > MAX_FRACTION_DIGITS) & (predicted.rlike(LONG_FRACTION) | gold.rlike(LONG_FRACTION))
    return (
        F.when(predicted.isNull() | gold.isNull(), "review")
        .when(same, "correct")
        .when(
            predicted.rlike(number) & gold.rlike(number),
            F.when(long & _equal_fractions(predicted, gold), "correct").otherwise("incorrect"),
        )
        .when(predicted.rlike(name) & gold.rlike(name), "incorrect")
        .otherwise("review")
    )


def grade(predicted: Column, gold: Column) -> Column:
    """Grade a predicted answer against the gold answer."""
    both = F.transform(F.array(predicted, gold), _normalize)
    full = let(both, lambda v: grade_normalized(v[0], v[1]))
    return (
        F.when(predicted.isNull() | gold.isNull(), "review")
        .when(
            predicted.rlike(PLAIN_INTEGER) & gold.rlike(PLAIN_INTEGER),
            F.when(predicted == gold, "correct").otherwise("incorrect"),
        )
        .otherwise(full)
    )


def rollout_status(termination_clean: Column, finish_reason: Column, parsed: Column) -> Column:
    """Classify a response as clean stop, truncated, malformed or unparsable."""
    return (
        F.when(~termination_clean & (finish_reason == "length"), "length_truncated")
        .when(~termination_clean, "malformed")
        .when(parsed.isNull(), "parse_invalid")
        .otherwise("clean_stop")
    )


def near_wrong_number(gold: Column, question_id: Column) -> Column:
    """Return a positive integer about five percent away from a gold integer."""
    value = gold.cast("long")
    step = F.greatest(F.lit(1), F.bround(F.abs(value) * F.lit(0.05)).cast("long"))
    odd = F.conv(F.substring(F.sha2(question_id, 256), -1, 1), 16, 10).cast("int") % 2 == 1
    moved = value + F.when(odd, step).otherwise(-step)
    return F.when((moved <= 0) | (moved == value), value + step).otherwise(moved).cast("string")
