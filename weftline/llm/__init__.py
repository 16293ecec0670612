"""Operators on texts and set-valued records for training data; nothing outside imports this package."""


def registries() -> list:
    """Query registries of this package."""
    from weftline.llm.plans import llm

    return [llm]
