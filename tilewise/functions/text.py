"""Text scores: tokens, longest common subsequence, ROUGE-L; numbers as text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType


#: Rows of an Arrow batch that are Python objects at once.
ROWS = 64


def _objects(c: pa.Array) -> list:
    """The rows of an array as Python objects; those of lists are made together."""
    if not pa.types.is_list(c.type):
        return c.to_pylist()
    n = c.value_lengths().to_pylist()
    flat = c.flatten()
    flat = flat.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(flat.type) or not flat.null_count else flat.to_pylist()
    out, at = [], 0
    for k in n:
        out.append(None if k is None else flat[at : at + k])
        at += k or 0
    return out


def by_rows(f: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """f of the rows of columns, as an Arrow array; a few rows at a time are Python objects, so a batch of long texts stays compact."""
    out = [pa.array([f(*row) for row in zip(*(_objects(c.slice(at, ROWS)) for c in columns))], kind) for at in range(0, len(columns[0]), ROWS)]
    return pa.concat_arrays(out) if out else pa.array([], kind)


def fixed(x: Column | str, digits: int) -> Column:
    """A number with so many digits after the point. The double's exact value is rounded, ties to even, as C and Python do."""
    return F.call_function("format_number", F.col(x) if isinstance(x, str) else x, F.lit("0." + "0" * digits))


def tokens(text: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9; everything else separates. Null: no tokens."""
    c = F.col(text) if isinstance(text, str) else text
    split = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.filter(split, lambda t: t != "")


def lcs_steps(b: list[str], a: list[str], at: Sequence[int], block: int = 8192) -> list[int]:
    """Lengths of the longest common subsequences of b and the first n tokens of a, for each n of ``at``.

    Bit-parallel, a block of b at a time: a step adds a number of as many bits as the block has tokens, and what it carries
    goes to the next block. Tokens that the block doesn't have and that carry nothing are no work. Memory is a carry for
    each token of a and the masks of one block, at most block squared / 16 bytes.
    """
    most = max(at, default=0)
    a = a[:most]
    wanted = sorted({min(n, len(a)) for n in at})
    found = dict.fromkeys(wanted, 0)
    carry = bytearray(len(a))
    for lo in range(0, len(b), block):
        part = b[lo : lo + block]
        mask: dict[str, int] = {}
        for i, t in enumerate(part):
            mask[t] = mask.get(t, 0) | 1 << i
        full = (1 << len(part)) - 1
        v, begin = full, 0
        for n in wanted:
            for i in range(begin, n):
                hit = v & mask.get(a[i], 0)
                if hit or carry[i]:
                    total = v + hit + carry[i]
                    carry[i] = total > full
                    v = (total | (v - hit)) & full
            begin = n
            found[n] += len(part) - v.bit_count()
    return [found[min(n, len(a))] for n in at]


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    return lcs_steps(b, a, [len(a)])[0]


@F.arrow_udf(IntegerType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """Longest common subsequence of two token arrays, in Arrow batches."""
    return by_rows(lcs, pa.int32(), a, b)


@F.arrow_udf(ArrayType(IntegerType()))
def lcs_lengths(reference: pa.Array, candidate: pa.Array, at: pa.Array) -> pa.Array:
    """Longest common subsequences of the reference and each prefix of the candidate whose length is in ``at``, in one pass."""
    return by_rows(lcs_steps, pa.list_(pa.int32()), reference, candidate, at)


def f_measure(common: Column, n_reference: Column, n_candidate: Column) -> Column:
    """F1 of precision common/n_candidate and recall common/n_reference; 0 where nothing is common."""
    return F.when(common > 0, 2.0 * common / (n_reference + n_candidate)).otherwise(F.lit(0.0))


def rouge_l_prefixes(reference: Column, candidate: Column, limits: Sequence[int]) -> Column:
    """ROUGE-L F1 of a reference and the candidate's first tokens, as an array in the order of the limits."""
    at = F.array(*[F.least(F.size(candidate), F.lit(n)) for n in limits])
    score = lambda common, n: f_measure(common, F.size(reference), n)
    return F.zip_with(lcs_lengths(reference, candidate, at), at, score)


def rouge_l(reference: Column, candidate: Column) -> Column:
    """ROUGE-L F1 of two token arrays."""
    return f_measure(lcs_length(reference, candidate), F.size(reference), F.size(candidate))


_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(stem: str) -> int:
    """Times a vowel run is followed by a consonant run."""
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(1 for x, y in zip(kinds, kinds[1:]) if not x and y)


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


#: The suffixes of steps 2, 3 and 4 of Porter's algorithm (1980), and what replaces them.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, pairs) -> tuple[str, str] | None:
    return max((p for p in pairs if w.endswith(p[0])), key=lambda p: len(p[0]), default=None)


def stem(w: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and _has_vowel(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for pairs in (STEP2, STEP3):
        found = _longest(w, pairs)
        if found and _measure(w[: -len(found[0])]) > 0:
            w = w[: -len(found[0])] + found[1]
    found = _longest(w, [(s, "") for s in STEP4])
    if found:
        rest = w[: -len(found[0])]
        if _measure(rest) > 1 and (found[0] != "ion" or rest[-1:] in ("s", "t")):
            w = rest
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _stemmer() -> Callable:
    """Stems of tokens of more than three characters, the others as they are; it keeps those of common tokens."""
    kept: dict[str, str] = {}

    def one(w: str) -> str:
        if w not in kept:
            if len(kept) > 200_000:
                kept.clear()
            kept[w] = stem(w) if len(w) > 3 else w
        return kept[w]

    return one


@F.arrow_udf(ArrayType(StringType()))
def stems(words: pa.Array) -> pa.Array:
    """Stems of the tokens of more than three characters; shorter ones stay."""
    one = _stemmer()
    return by_rows(lambda row: [one(w) for w in row], pa.list_(pa.string()), words)


@F.arrow_udf(IntegerType())
def stems_lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """Longest common subsequence of the stems of two token arrays. Stems are made where they are compared and are no column."""
    one = _stemmer()
    return by_rows(lambda x, y: lcs([one(w) for w in x], [one(w) for w in y]), pa.int32(), a, b)


def rouge_l_stems(reference: Column, candidate: Column) -> Column:
    """ROUGE-L F1 of the stems of two token arrays."""
    return f_measure(stems_lcs_length(reference, candidate), F.size(reference), F.size(candidate))
