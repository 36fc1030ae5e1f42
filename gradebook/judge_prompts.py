"""Default judge-prompt catalog.

The wording and layout here are this library's own; only the *field contract*
(template names, types, output formats and placeholder names) follows the
evaluation protocol.  Users can load their own catalog with
``sources.readers.read_judge_prompts``.
"""

from __future__ import annotations

from gradebook import fixed

_PAIR_SYS = (
    "You referee a contest between two AI assistants. Read the question and both replies, "
    "weigh helpfulness, relevance, accuracy and depth, and ignore reply order, length and "
    "assistant names. Give a short justification, then the verdict exactly as \"[[A]]\" "
    "(assistant A wins), \"[[B]]\" (assistant B wins) or \"[[C]]\" (a draw)."
)
_PAIR_SYS_MT = (
    "You referee a two-turn contest between two AI assistants. Judge how each one handles "
    "the second question given the first. Justify briefly, then answer exactly \"[[A]]\", "
    "\"[[B]]\" or \"[[C]]\" for a draw."
)
_PAIR_SYS_REF = (
    "You referee a contest between two AI assistants and hold a reference answer. Check both "
    "replies against it and name their mistakes. Justify briefly, then answer exactly "
    "\"[[A]]\", \"[[B]]\" or \"[[C]]\" for a draw."
)
_PAIR_SYS_REF_MT = (
    "You referee a two-turn contest between two AI assistants and hold reference answers for "
    "both turns. Focus on the second turn, check both replies against the references, justify "
    "briefly, then answer exactly \"[[A]]\", \"[[B]]\" or \"[[C]]\"."
)
_SINGLE_MT_SYS = (
    "Grade one AI assistant's reply to the second question of the dialog below for "
    "helpfulness, relevance, accuracy and depth. Justify briefly, then give a grade from 1 to "
    "10 written exactly as \"[[grade]]\", e.g. \"Grade: [[6]]\"."
)
_SINGLE_REF_MT_SYS = (
    "Grade one AI assistant's reply to the second question of the dialog below against the "
    "reference answers. Name its mistakes, justify briefly, then give a grade from 1 to 10 "
    "written exactly as \"[[grade]]\"."
)

_PAIR_1 = (
    "<question>\n{question}\n</question>\n\n"
    "<reply from=\"A\">\n{answer_a}\n</reply>\n\n"
    "<reply from=\"B\">\n{answer_b}\n</reply>"
)
_PAIR_REF_1 = (
    "<question>\n{question}\n</question>\n\n"
    "<reference>\n{ref_answer_1}\n</reference>\n\n"
    "<reply from=\"A\">\n{answer_a}\n</reply>\n\n"
    "<reply from=\"B\">\n{answer_b}\n</reply>"
)
_PAIR_MT = (
    "<dialog with=\"A\">\nQ1: {question_1}\nA1: {answer_a_1}\nQ2: {question_2}\nA2: {answer_a_2}\n</dialog>\n\n"
    "<dialog with=\"B\">\nQ1: {question_1}\nA1: {answer_b_1}\nQ2: {question_2}\nA2: {answer_b_2}\n</dialog>"
)
_PAIR_REF_MT = (
    "<reference>\nQ1: {question_1}\nR1: {ref_answer_1}\nQ2: {question_2}\nR2: {ref_answer_2}\n</reference>\n\n"
    + _PAIR_MT
)
_SINGLE_1 = (
    "Task: grade the reply below for helpfulness, relevance, accuracy and depth. Justify "
    "briefly, then give a grade from 1 to 10 written exactly as \"[[grade]]\", e.g. "
    "\"Grade: [[6]]\".\n\n"
    "<question>\n{question}\n</question>\n\n<reply>\n{answer}\n</reply>"
)
_SINGLE_REF_1 = (
    "Task: grade the reply below against the reference answer. Name its mistakes, justify "
    "briefly, then give a grade from 1 to 10 written exactly as \"[[grade]]\".\n\n"
    "<question>\n{question}\n</question>\n\n<reference>\n{ref_answer_1}\n</reference>\n\n"
    "<reply>\n{answer}\n</reply>"
)
_SINGLE_MT = "<dialog>\nQ1: {question_1}\nA1: {answer_1}\nQ2: {question_2}\nA2: {answer_2}\n</dialog>"
_SINGLE_REF_MT = (
    "<reference>\nQ1: {question_1}\nR1: {ref_answer_1}\nQ2: {question_2}\nR2: {ref_answer_2}\n</reference>\n\n"
    + _SINGLE_MT
)

# name, type, system_prompt, prompt_template, description, category, output_format
CATALOG: list[tuple[str, str, str, str, str, str, str]] = [
    ("pair-v2", "pairwise", _PAIR_SYS, _PAIR_1, "pairwise, one turn", "general", fixed.FORMAT_LETTER),
    ("pair-v2-multi-turn", "pairwise", _PAIR_SYS_MT, _PAIR_MT, "pairwise, two turns", "general", fixed.FORMAT_LETTER),
    ("pair-math-v1", "pairwise", _PAIR_SYS_REF, _PAIR_REF_1, "pairwise math with reference", "math", fixed.FORMAT_LETTER),
    ("pair-math-v1-multi-turn", "pairwise", _PAIR_SYS_REF_MT, _PAIR_REF_MT, "pairwise math, two turns", "math", fixed.FORMAT_LETTER),
    ("pair-ref-v1", "pairwise", _PAIR_SYS_REF, _PAIR_REF_1, "pairwise with reference", "general", fixed.FORMAT_LETTER),
    ("pair-ref-v1-multi-turn", "pairwise", _PAIR_SYS_REF_MT, _PAIR_REF_MT, "pairwise with reference, two turns", "general", fixed.FORMAT_LETTER),
    ("single-v1", "single", fixed.STOCK_SYSTEM_PROMPT, _SINGLE_1, "single grade", "general", fixed.FORMAT_RATING),
    ("single-math-v1", "single", fixed.STOCK_SYSTEM_PROMPT, _SINGLE_REF_1, "single grade, math", "math", fixed.FORMAT_RATING),
    ("single-v1-multi-turn", "single", _SINGLE_MT_SYS, _SINGLE_MT, "single grade, two turns", "general", fixed.FORMAT_RATING),
    ("single-math-v1-multi-turn", "single", _SINGLE_REF_MT_SYS, _SINGLE_REF_MT, "single grade, math, two turns", "math", fixed.FORMAT_RATING),
    ("single-ref-v1", "single", fixed.STOCK_SYSTEM_PROMPT, _SINGLE_REF_1, "single grade with reference", "general", fixed.FORMAT_RATING),
    ("single-ref-v1-multi-turn", "single", _SINGLE_REF_MT_SYS, _SINGLE_REF_MT, "single grade with reference, two turns", "general", fixed.FORMAT_RATING),
]

COLUMNS = ["name", "type", "system_prompt", "prompt_template", "description", "category", "output_format"]


def as_dict() -> dict[str, dict[str, str]]:
    return {row[0]: dict(zip(COLUMNS, row)) for row in CATALOG}
