"""The catalogue's dimension tables."""

from __future__ import annotations

# Nominal diameter, capacity (t/h), longest run (m), cost per m, width of a pair (m).
DIAMETERS = [
    (50, 3.5, 181, 74023, 0.40), (65, 8.3, 245, 78631, 0.43), (80, 13.2, 327, 83530, 0.47), (100, 22.3, 419, 89748, 0.51),
    (125, 40.2, 554, 97275, 0.60), (150, 65.1, 696, 105507, 0.65), (200, 152.3, 1042, 120275, 0.88), (250, 274.9, 1379, 135323, 1.05),
    (300, 437.4, 1718, 150022, 1.15), (400, 943.1, 2477, 190299, 1.37), (500, 1663.4, 3245, 224137, 1.67), (600, 2627.7, 4037, 264790, 1.85),
    (700, 3735.1, 4775, 324298, 2.05), (800, 5296.8, 5644, 325996, 2.25), (900, 7165.0, 6518, 327693, 2.45), (1000, 9391.8, 7419, 418777, 2.65),
    (1200, 15012.8, 9288, 428074, 3.10), (1400, 22501.9, 11276, 683417, 3.45),
]
# First and last diameter of a band, cost of a chamber.
CHAMBER_COSTS = [(50, 200, 3_000_000), (250, 500, 5_000_000), (600, 1000, 8_000_000), (1200, 1400, 12_000_000)]
# Restriction type, rule, least distance (None: by diameter), cost factor.
RESTRICTIONS = [
    ("oks_existing", "FORBIDDEN", None, 1.0), ("park", "FORBIDDEN", 1.0, 1.0), ("social_area", "FORBIDDEN", 1.0, 1.0), ("prohibited_site", "FORBIDDEN", 1.0, 1.0),
    ("water", "FORBIDDEN", 1.0, 1.0), ("railway", "FORBIDDEN", 1.0, 1.0), ("road", "SPECIAL_CROSSING", 1.5, 1.6), ("tram_tracks", "SPECIAL_CROSSING", 1.5, 1.75),
    ("gas_pipeline", "SPECIAL_CROSSING", 2.0, 1.25), ("power_cable", "SPECIAL_CROSSING", 2.0, 1.15), ("heat_network", "SPECIAL_CROSSING", 1.0, 1.05),
]
# Restriction type, least crossing angle (degrees), least depth of cover below its surface (m), margin of the special part (m), whether that part lies within the polygon.
CROSSINGS = [
    ("road", 45, 1.0, 3.0, True), ("tram_tracks", 45, 1.2, 3.0, True), ("gas_pipeline", None, None, 2.0, False), ("power_cable", None, None, 2.0, False), ("heat_network", None, None, 2.0, False),
]
# Longest run alongside a special object (m), nearby objects explained (m beyond the required distance), a distance that binds, one that touches (m).
ALONGSIDE, NEARBY, BINDING, TOUCHING = 3.0, 12.0, 0.5, 0.05
# Usual depth (m), half of a flat part (m), steepest slope.
USUAL_DEPTH, FLAT_HALF, SLOPE = 3.0, 2.0, 0.1
# Alias, restriction type.
ALIASES = [
    ("oks", "oks_existing"), ("oks_exist", "oks_existing"), ("building", "oks_existing"), ("existing_building", "oks_existing"),
    ("railroad", "railway"), ("rail", "railway"), ("railway_track", "railway"), ("tram", "tram_tracks"), ("tramway", "tram_tracks"),
    ("metro", "railway"), ("subway", "railway"), ("school", "social_area"), ("kindergarten", "social_area"), ("hospital", "social_area"),
    ("clinic", "social_area"), ("highway", "road"), ("street", "road"), ("river", "water"), ("water_object", "water"), ("green", "park"),
    ("green_area", "park"), ("gas", "gas_pipeline"), ("cable", "power_cable"), ("heating_network", "heat_network"), ("heat_net", "heat_network"),
]
# Largest diameter, least distance to existing buildings.
BUILDING_DISTANCES = [(400, 5.0), (800, 7.0), (1400, 9.0)]
# Costs, penalties, score weights and bases, depth limits.
TIE_IN_COST, PENALTY, PENALTY_PER_FLOW = 5_000_000, 100_000_000, 500_000
COST_WEIGHT, LENGTH_WEIGHT, COST_BASE, LENGTH_BASE = 0.7, 0.3, 25_000_000, 100
FREE_DEPTH, DEPTH_STEP = 3.0, 0.10
SNAP_RADIUS, MAX_DEGREE = 10, 4


def values(rows: list[tuple]) -> str:
    """Rows as SQL VALUES, for either engine."""
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
