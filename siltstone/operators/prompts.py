"""Prompts as string columns: what a teacher or judge is asked. Replies come from a provider (see sources.providers).

The wording is this library's own; {passage}, {question} and the like are filled from columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES = {
    "qa": "From the passage below make {n} different questions, each clear on its own, each with a word-for-word quote that proves its answer, a short answer and a difficulty (easy, medium or hard). Reply with a JSON list of question, quote, answer, difficulty.\n\nPASSAGE:\n{passage}",
    "summarize": "Ask for a summary of the text below and give one that adds nothing to it. Reply with JSON: instruction, answer.\n\nTEXT:\n{passage}",
    "extract": "Ask for the main named fields of the text below and give them as a JSON string. Reply with JSON: instruction, answer.\n\nTEXT:\n{passage}",
    "rewrite": "Ask for the text below in plain words and give it so, its meaning kept. Reply with JSON: instruction, answer.\n\nTEXT:\n{passage}",
    "unanswerable": "Make {n} questions on the subject of the passage below that it does not answer. Reply with a JSON list of question.\n\nPASSAGE:\n{passage}",
    "evolve": "Make the question harder by one step of reasoning or one condition, still answered by the passage alone. Reply with JSON: question, quote, answer.\n\nPASSAGE:\n{passage}\n\nQUESTION: {question}",
    "judge": "By the passage alone, is the answer right and complete (correct, 1 to 5), and is all of it supported (grounded, true or false)? Reply with JSON: correct, grounded, reason.\n\nPASSAGE:\n{passage}\n\nQUESTION: {question}\nANSWER: {answer}",
    "pref_pair": "Answer the question from the context twice: well (chosen), and plausibly but worse (rejected). Reply with JSON: chosen, rejected.\n\nCONTEXT:\n{passage}\n\nQUESTION: {question}",
    "pref_judge": "Which answer serves the question better by the context, A or B, and by how much (1 to 5)? Reply with JSON: better, margin, reason.\n\nCONTEXT:\n{passage}\n\nQUESTION: {question}\n\nANSWER A: {a}\n\nANSWER B: {b}",
    "eval_judge": "Compare the answer with the reference by the context: correct (1 to 5), grounded, matches_ref. Reply with JSON.\n\nCONTEXT:\n{passage}\n\nQUESTION: {question}\n\nREFERENCE: {answer}\n\nANSWER: {reply}",
    "rubric": "Grade the answer: correctness 0 to 5, completeness 0 to 2, groundedness 0 to 2, clarity 0 to 1. Reply with JSON.\n\nCONTEXT:\n{passage}\n\nQUESTION: {question}\n\nREFERENCE: {answer}\n\nANSWER: {reply}",
    "pairwise": "Which answer is better, A, B or a tie? Reply with JSON: winner.\n\nQUESTION: {question}\n\nREFERENCE: {answer}\n\nANSWER A: {a}\n\nANSWER B: {b}",
}


def prompt(kind: str, **fields: Column) -> Column:
    """A template with its fields filled; null fields count as empty."""
    parts = re.split(r"(\{[a-z]+\})", TEMPLATES[kind])
    return F.concat(*[F.coalesce(fields[p[1:-1]].cast("string"), F.lit("")) if re.fullmatch(r"\{[a-z]+\}", p) else F.lit(p) for p in parts if p])


def sql(kind: str, **fields: str) -> str:
    """prompt() in SQL."""
    parts = re.split(r"(\{[a-z]+\})", TEMPLATES[kind])
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    return " || ".join(f"coalesce(({fields[p[1:-1]]})::varchar, '')" if re.fullmatch(r"\{[a-z]+\}", p) else quoted(p) for p in parts if p)
