"""What a route screen shows: merged positions, thinned, with the camera that frames them."""

from pyspark.sql import DataFrame

from wayfold.functions.predicates import in_window
from wayfold.operators.ordered import Slicing
from wayfold.operators.route import camera, merge_positions, thin


def route_view(
    local: DataFrame, server: DataFrame, frm, to, min_m: float = 15.0, slicing: Slicing | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(route points, camera per vehicle, merge statistics per vehicle) for [frm, to)."""
    window = in_window("recorded_at", frm, to)
    merged, stats = merge_positions(local.filter(window), server.filter(window))
    points = thin(merged, ("vehicle_id",), min_m, slicing)
    return points, camera(merged), stats
