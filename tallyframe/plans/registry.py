"""All registered queries: name -> callable(spark, sf_dir), and name -> SQL."""

from __future__ import annotations

from tallyframe.plans import connectors, expressions, relational, statistics, studies

FLAGSHIP = "FLAGSHIP_game_states"
QUERIES: dict = relational.QUERIES | expressions.QUERIES | statistics.QUERIES | studies.QUERIES | connectors.QUERIES
ORACLES: dict = relational.ORACLES | expressions.ORACLES | statistics.ORACLES | connectors.ORACLES
