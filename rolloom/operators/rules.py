"""Extraction and checking by the dataset registry.

The registry names a dataset's rules; here the names are bound to functions,
once, when the plan is built. What a row needs at run time is the name of its
dataset: its settings are literal maps, and every distinct rule is one branch,
however many datasets share it. A name that no function is known for fails
before anything runs, a dataset that is not registered fails its row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolloom.functions import check as ck
from rolloom.functions import extract as ex
from rolloom.operators.prepare import option_letters, resolve_domain
from rolloom.sources.registry import DATASETS, Dataset, setting

Extractor = Callable[[Column], Column]
Checker = Callable[[Column, Column], Column]

EXTRACTORS: dict[str, Extractor] = {
    "phrase": ex.stated_phrase,
    "number": ex.stated_number,
    "ending": ex.ending_letter,
    "wide": ex.wide_letter,
    "last_block": ex.last_python_block,
}
CHECKERS: dict[str, Checker] = {"phrase": ck.same_phrase, "number": ck.same_number, "letter": ck.same_letter}


def bound(field: str, hooks: Mapping[str, Callable], datasets: Mapping[str, Dataset]) -> dict[str, Callable]:
    """The functions of all rules the registry uses. Fails on an unknown name."""
    used = {name: getattr(d, field) for name, d in datasets.items() if getattr(d, field) is not None}
    lost = {name: rule for name, rule in used.items() if rule not in hooks}
    if lost:
        raise ValueError(f"no {field} rule for {lost}; known: {sorted(hooks)}")
    return {rule: hooks[rule] for rule in sorted(set(used.values()))}


def letters(dataset: Column, datasets: Mapping[str, Dataset] | None = None) -> Column:
    """Option letters of a row's dataset: its own, its file's, or the default."""
    return option_letters(setting(dataset, "letters", datasets), setting(dataset, "path", datasets))


def letter_sets(datasets: Mapping[str, Dataset]) -> list[str]:
    """The distinct sets that ``letters`` can give."""
    from rolloom.operators.prepare import DATASET_LETTERS

    stems = {d.path.rsplit("/", 1)[-1].rsplit(".", 1)[0] for d in datasets.values()}
    own = {d.letters for d in datasets.values() if d.letters}
    return sorted(own | {DATASET_LETTERS[s] for s in stems if s in DATASET_LETTERS})


def registered(dataset: Column, datasets: Mapping[str, Dataset]) -> Column:
    """The dataset's name; a name that is not registered fails. NULL is no dataset."""
    message = F.concat(F.lit("unknown dataset "), dataset)
    return F.when(dataset.isNull() | dataset.isin(*datasets), dataset).otherwise(F.raise_error(message).cast("string"))


def domain(dataset: Column, row_domain: Column, datasets: Mapping[str, Dataset] | None = None) -> Column:
    """The row's label, that of its dataset, or math."""
    return resolve_domain(row_domain, setting(dataset, "domain", datasets))


def answer(
    text: Column,
    dataset: Column,
    row_domain: Column,
    fn_name: Column,
    datasets: Mapping[str, Dataset] | None = None,
    extractors: Mapping[str, Extractor] | None = None,
    scorer: Column | None = None,
    scorers: dict | None = None,
) -> Column:
    """The answer of a row by the rule its dataset is registered with.

    Without a rule of its own the dataset is read by scorer and domain.
    """
    datasets = DATASETS if datasets is None else datasets
    hooks = EXTRACTORS if extractors is None else {**EXTRACTORS, **extractors}
    name = registered(dataset, datasets)
    return ex.answer(
        text,
        domain(name, row_domain, datasets),
        fn_name,
        override=setting(name, "extract", datasets),
        letters=letters(name, datasets),
        letter_sets=letter_sets(datasets),
        scorer=scorer,
        overrides=bound("extract", hooks, datasets),
        scorers=scorers,
    )


def correct(
    pred: Column,
    golds: Column,
    dataset: Column,
    row_domain: Column,
    recorded: Column | None = None,
    datasets: Mapping[str, Dataset] | None = None,
    checkers: Mapping[str, Checker] | None = None,
    scorer: Column | None = None,
    scorers: dict | None = None,
) -> Column:
    """The verdict of a row by the rule its dataset is registered with."""
    datasets = DATASETS if datasets is None else datasets
    hooks = CHECKERS if checkers is None else {**CHECKERS, **checkers}
    name = registered(dataset, datasets)
    return ck.correct(
        pred,
        golds,
        domain(name, row_domain, datasets),
        recorded=recorded,
        override=setting(name, "check", datasets),
        scorer=scorer,
        overrides=bound("check", hooks, datasets),
        scorers=scorers,
    )
