"""Several sets of sheets in one graph: a number of one set answers for none of another's."""

import pytest

from test_room_numbers import test_keys_beyond_the_letters as beyond


@pytest.mark.parametrize("name", ["X10_resolved_tags", "X09_graph_rooms"])
def test_numbers_recur_in_other_sets(spark, tmp_path, name):
    beyond(spark, tmp_path, name)
