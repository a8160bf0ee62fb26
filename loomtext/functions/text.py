"""Transcript cleaning as Column -> Column chains of JVM regular expressions; no Python runs on the data.

``(?U)`` makes classes such as ``\\s`` and ``\\w`` Unicode-aware; the separators U+001C to U+001F count as
white space as well. A null text becomes an empty one.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\s\x1C-\x1F]"
#: The characters of WS in a Unicode-aware pattern, one by one.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A run of white space that isn't just one space.
RUN = rf"(?:[\s\x1C-\x1F&&[^ ]]{WS}*| {WS}+)"

# The token for unintelligible speech, and the annotation patterns of the transcripts.
UNK = "【聽不清楚】"
HAN = r"[\x{4e00}-\x{9fff}]"
UNK_ANY = rf"[\[【]{WS}*聽不清楚{WS}*[\]】]"
UNK_RUN = rf"(?:{UNK}{WS}*){{2,}}"
# Letters, digits and spaces are settled before the long class is asked. Each by itself, not as ranges: the JVM looks
# single Latin characters up in one table, but asks every range by a call of its own, for each character of a text.
SOLID = string.ascii_letters + string.digits
PLAIN = SOLID + " "
NOT_ALLOWED = (
    rf"[[^{PLAIN}]&&" r"[^\x{4e00}-\x{9fff}A-Za-z0-9\s\x1C-\x1F\[\]\(\)<>&\+\-_/\\"
    r"，。！？；：、（）「」『』《》…【】\.,!?;:\"“”'·]]"
)
ZHUYIN = r"[\x{3105}-\x{3129}]+"
HESITATION_RUN = r"(?:嗯[\s\x1C-\x1F、，,.!?]*){2,}"
SPEAKER_WORDS = ("醫生", "病人", "受試者")
SPEAKERS = (
    rf"(?i)\b(?:Doctor|Patient|Interviewer){WS}*[:：]",
    rf"(?i)Speaker{WS}*\d+{WS}*[:：]",
    rf"(?:{'|'.join(SPEAKER_WORDS)}){WS}*[:：]",
)
TIER_CODES = (r"\d+_\d+", r"(?:%\w+|\*[A-Z]+):", r"\b\w+:\w+\|\w+")
MARKERS = (
    (rf"<{WS}*(?:\.{WS}*){{3,}}>", " <...> "),
    (rf"(?i)\[\+{WS}*gram{WS}*\]", " [+ gram] "),
    (rf"\[{WS}*//{WS}*\]", " [//] "),
    (rf"\[{WS}*/{WS}*\]", " [/] "),
)
FILLED_PAUSES = ("uh", "um")
PAREN, ANGLE, BRACKET = r"\([^)]*\)", r"<(?!\.\.\.>)[^>]*>", r"\[(?!(?://|/|\+ gram)\])[^\]]*\]"
CODES = (r"\+<[^>]*>", rf"(?:(?<={WS})|^)\+[A-Za-z0-9_-]+(?=(?:{WS}|$))", r"&(?!(?:-[A-Za-z]+))[^\s\x1C-\x1F]+")
DIALECT_TAG = rf"【{WS}*[^】]{{0,12}}(?:话|話){WS}*】|【{WS}*方言{WS}*】"
MARKER_WORDS = (("[//]", " RETRACE "), ("[/]", " REPEAT "), ("[+ gram]", " GRAM "), ("<...>", " PAUSE "))
PUNCTUATION = rf"[[^{PLAIN}]&&" r"[，。、「」『』？！：；（）《》〈〉—…,.!?;:()\"“”'\-]]"
NOT_BASIC = rf"[[^{PLAIN}]&&" r"[^\x{4e00}-\x{9fff}A-Za-z0-9_\s\x1C-\x1F]]"


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with these columns, each computed once: filters on them aren't pushed below and so not repeated there."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))


def sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, F.lit("(?U)" + pattern), F.lit(to))


def chain(text: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda t, step: sub(t, *step), steps, text)


def present(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends, which alone are looked at."""
    return F.trim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, ends are stripped."""
    return F.trim(sub(text, RUN, " "))


def blanked(text: Column, odd: str) -> Column:
    """``squeeze`` of a text whose odd characters (a class, or several) are spaces, in one pass. No letter, digit or Han character is odd."""
    gap = lambda solid: rf"[[^{solid}]&&[^\x{{4e00}}-\x{{9fff}}]&&[{odd}\s\x1C-\x1F]]"
    return F.trim(sub(text, f"(?:{gap(PLAIN)}{gap(SOLID)}*| {gap(SOLID)}+)", " "))


def where_any(text: Column, marks: Sequence[str], change: Callable[[Column], Column]) -> Column:
    """``change`` of texts that hold one of ``marks``; others are as they are, and none of its patterns is tried on them.

    Each match of the patterns must need one of the marks. The text is computed once, through an array of one.
    """
    held = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(m)) for m in marks])
    return F.element_at(F.transform(F.array(text), lambda t: F.when(held(t), change(t)).otherwise(t)), 1)


def marked(text: Column, marks: str | Sequence[str], *steps: tuple[str, str]) -> Column:
    """``chain`` where one of the marks (or the one mark) is there."""
    return where_any(text, [marks] if isinstance(marks, str) else marks, lambda t: chain(t, *steps))


def normalise_unintelligible(text: Column) -> Column:
    """Bracketed variants become the token; a run of tokens becomes one and a space."""
    return marked(text, "聽不清楚", (UNK_ANY, UNK), (UNK_RUN, f"{UNK} "))


def _normalised_again(text: Column) -> Column:
    """A squeezed text, normalised and squeezed again where that changes anything."""
    return where_any(text, ["聽不清楚"], lambda t: squeeze(normalise_unintelligible(t)))


def sanitise(text: Column) -> Column:
    """Everything outside the list of allowed characters becomes a space, runs of which become one."""
    return blanked(present(text), NOT_ALLOWED)


def clean_asr(text: Column) -> Column:
    """Recogniser output: phonetic symbols and repeated hesitations become one, odd characters go."""
    text = normalise_unintelligible(present(text))
    text = marked(chain(text, (ZHUYIN, "嗯")), "嗯", (HESITATION_RUN, "嗯 "))
    return _normalised_again(sanitise(text))


def _filled_pauses(text: Column, form: str) -> Column:
    """Each kept pause in ``form`` (lower-cased), every other ``&-word`` a space."""
    for word in FILLED_PAUSES:
        text = sub(text, rf"(?i)&-{word}(?![a-z])", " " + form.format(word) + " ")
    return text


def _other_pauses(text: Column) -> Column:
    kept = "|".join(FILLED_PAUSES)
    return sub(text, rf"(?i)&-(?!(?:{kept})(?![a-z]))[a-z]+", " ")


def clean_structured(text: Column) -> Column:
    """Annotated transcripts: speaker names, tiers and researcher codes go, the known markers stay."""
    text = normalise_unintelligible(F.replace(present(text), F.lit(" "), F.lit(" ")))
    text = where_any(text, [":", "："], lambda t: marked(chain(t, *((p, "") for p in SPEAKERS[:2])), SPEAKER_WORDS, (SPEAKERS[2], "")))
    text = marked(marked(text, "_", (TIER_CODES[0], "")), ":", (TIER_CODES[1], ""))
    text = where_any(text, ["|"], lambda t: marked(t, ":", (TIER_CODES[2], "")))
    text = marked(marked(text, "<", MARKERS[0]), "[", *MARKERS[1:])
    text = where_any(text, ["&-"], lambda t: _filled_pauses(_other_pauses(t), "&-{}"))
    text = marked(text, "&", (rf"&({HAN})", "$1"))
    for mark, span in (("[", BRACKET), ("<", ANGLE), ("(", PAREN)):
        text = marked(text, mark, (span, " "))
    text = F.replace(text, F.lit("‡"), F.lit(" "))
    for mark, code in zip(("+", "+", "&"), CODES, strict=True):
        text = marked(text, mark, (code, " "))
    # squeezed from here on: what is marked becomes one of its repeats, and no new space comes in
    text = sanitise(marked(text, "【", (DIALECT_TAG, " ")))
    text = marked(text, "<...>", (rf"(<\.\.\.>)(?:{WS}+\1)+", "$1"))
    text = marked(text, "[+", (rf"(?i)(\[\+{WS}*gram\])(?:{WS}+\1)+", "[+ gram]"))
    text = marked(text, "&-", *((rf"(?i)&-{w}(?:{WS}+&-{w})+", f"&-{w}") for w in FILLED_PAUSES))
    return _normalised_again(text)


def clean_structured_words(text: Column, *, same_case: bool = False) -> Column:
    """The same with markers as words and without punctuation.

    A run of filled pauses becomes an upper-case word, a single one stays lower-case; ``same_case`` keeps both lower.
    """
    text = clean_structured(text)
    for marker, word in MARKER_WORDS:
        text = F.replace(text, F.lit(marker), F.lit(word))
    text = where_any(text, ["&-"], lambda t: _other_pauses(_filled_pauses(t, "FILLPAUSE_{}")))
    text = blanked(text, PUNCTUATION + NOT_BASIC)
    text = marked(text, "PAUSE", (rf"(PAUSE)(?:{WS}+\1)+", "$1"))
    text = marked(text, "GRAM", (rf"(GRAM)(?:{WS}+\1)+", "$1"))
    runs = {w: f"FILLPAUSE_{w if same_case else w.upper()}" for w in FILLED_PAUSES}
    return marked(text, "_", *((rf"(?i)FILLPAUSE_{w}(?:{WS}+FILLPAUSE_{w})+", run) for w, run in runs.items()))


def clean_transcript(text: Column) -> Column:
    """Both cleaners, the recogniser's first: what the corpus plan applies."""
    return clean_structured(clean_asr(text))
