"""Queries over the catalogue's tables, by subject."""


def registries() -> list:
    from kinweft.plans import checks, importing, layouts, merging, pedigree, search, streams, structure

    return [checks.REG, importing.REG, layouts.REG, merging.REG, pedigree.REG, search.REG, streams.REG, structure.REG]
