"""Expected values of games that only move forward."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestwright.functions._inputs import named, strict


def _fail(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("double")


def expected_value_of_game(game: Any) -> Column:
    """The value of the first state of array<array<struct<probability, value, next_state>>>, a double.

    A state is worth the sum, over its actions, of probability * (value + what the next state is worth). States are
    taken from the last back, with the values so far in front of each other. Fewer than two states are worth 0. Errors
    of the query: a null game, state or field; a last state with actions; a next_state that isn't a later state."""
    states = strict(game, "a game is a column")
    n = F.size(states)

    def worth(later: Column, i: Column) -> Column:
        def add(total: Column, a: Column) -> Column:
            probability, value, following = a["probability"].cast("double"), a["value"].cast("double"), a["next_state"].cast("long")
            gain = probability * (value + F.element_at(later, (following - i).cast("int")))
            missing = a.isNull() | probability.isNull() | value.isNull() | following.isNull()
            wrong = F.raise_error(F.concat(F.lit("next_state in state "), i.cast("string"), F.lit(" must be greater than "), i.cast("string"), F.lit(" and less than "), n.cast("string"))).cast("double")
            return total + F.when(missing, _fail("actions must not have null fields")).when((following > i) & (following < n), gain).otherwise(wrong)

        actions = states[i]
        return F.when(actions.isNull(), _fail("states must not be null")).otherwise(F.aggregate(actions, F.lit(0.0), add))

    values = F.aggregate(F.sequence(n - 2, F.lit(0), F.lit(-1)), F.array(F.lit(0.0)), lambda later, i: F.concat(F.array(worth(later, i)), later))
    last = states[n - 1]
    out = (
        F.when(states.isNull(), _fail("the game must not be null"))
        .when(n < 2, F.lit(0.0))
        .when(last.isNull(), _fail("states must not be null"))
        .when(F.size(last) > 0, _fail("the final state must have no actions"))
        .otherwise(values[0])
    )
    return named(out, game)
