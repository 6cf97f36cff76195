"""Prompts for answers, judgement and question generation, as column templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import cut

REASONING = ("reasoning", "comparison")


def answer_prompt(question: Column, context: Column, kind: Column, context_chars: int | None = None) -> Column:
    """A prompt for a five-field answer; questions that need reasoning are asked to show their steps."""
    body = cut(context, context_chars) if context_chars else context
    steps = F.when(kind.isin(*REASONING), F.lit("Think step by step and compare the sources before you answer.\n")).otherwise(F.lit(""))
    fields = "Reply with **Answer:**, **Evidence:**, **Confidence:** (High, Medium or Low), **Safety Notes:** and **Missing Info:**, each on a line of its own.\n"
    return F.concat(F.lit("Answer from the context only.\n"), steps, F.lit(fields), F.lit("Question: "), question, F.lit("\nContext:\n"), body)


def plain_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer the question from the context.\nQuestion: "), question, F.lit("\nContext:\n"), context)


def judge_pair(number: Column, question: Column, context: Column, answer: Column, reference: Column) -> Column:
    """One numbered entry of a judge's batch, with its fields cut to their budgets."""
    return F.format_string("[%d]\nQuestion: %s\nContext: %s\nAnswer: %s\nReference: %s", number, cut(question, 200), cut(context, 800), cut(answer, 400), cut(reference, 200))


def question_prompt(text: Column, pages: Column, n: int | Column, mix: tuple[int, int, int] = (20, 50, 30)) -> Column:
    """A prompt for n questions with a mix of easy, medium and hard ones in percent."""
    count = n if isinstance(n, Column) else F.lit(n)
    head = f" questions as a JSON list with question, answer, question_type, difficulty, page_reference and evidence_snippets. Difficulty: {mix[0]}% easy, {mix[1]}% medium, {mix[2]}% hard.\nPages: "
    return F.concat(F.lit("Write "), count.cast("string"), F.lit(head), F.array_join(pages.cast("array<string>"), ", "), F.lit("\nText:\n"), text)
