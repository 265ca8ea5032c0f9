"""Every registered query of the library proper."""

from lodestone.plans import answering, comparing, judging, keeping, listing, outlining, preparing, publishing, searching
from lodestone.query_set import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answering", "comparing", "judging", "keeping", "listing", "outlining", "preparing", "publishing", "searching"]
