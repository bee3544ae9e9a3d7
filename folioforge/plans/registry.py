"""All queries of the engine with their SQL."""

from folioforge.plans import entities, works
from folioforge.plans.biblio import QUERIES
from folioforge.plans.entities_oracles import ORACLES as _ENTITIES
from folioforge.plans.oracles import ORACLES as _BIBLIO
from folioforge.plans.works_oracles import ORACLES as _WORKS

ORACLES = {**_BIBLIO, **_WORKS, **_ENTITIES}
#: Queries whose results SQL cannot express: BLAKE2b and a layout by forces. Tests hold their operators against their invariants.
WITHOUT_SQL = ("canvas_cards",)
__all__ = ["ORACLES", "QUERIES", "WITHOUT_SQL", "entities", "works"]
