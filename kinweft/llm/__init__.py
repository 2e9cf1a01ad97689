"""Operators for training data. Nothing else in the library imports this package."""


def registries() -> list:
    from kinweft.llm import queries

    return [queries.REG]
