"""Fixed values of the analyses: thresholds, weights and tables. Functions take them as defaults."""

# Doors and labels
DOOR_HALF_WIDTH, DOOR_OFFSET = 1.0, 0.5
MATCH_RADIUS = 120.0

# Networks
R_MAX = 50.0
TOBLER_KMH, TOBLER_SLOPE, TOBLER_SHIFT, TOBLER_KMH_TO_MS, FALLBACK_MS = 6.0, -3.5, 0.05, 3.6, 0.1
BETA, BARRIER_PERCENTILE, BARRIER_STEP, BARRIER_SAMPLES = 1.5, 0.95, 0.2, 10
GABRIEL_TOL, HUB_GABRIEL_TOL = 1e-9, 1e-5

# Corridors and hubs
ROAD_OFFSET, STREET_EPS = 3.5, 10.0
GAP, MAX_LENGTH = 12.0, 35.0
STD_FLOOR, END_EXTENSION, DEFAULT_HALF = 0.1, 1.0, 2.0
DOUBLE_CHAPELS = (116, 120)
CONNECT_MIN, CONNECT_MAX = 0.1, 12.0
HUB_EPS, HUB_MIN, HUB_MAJOR = 12.0, 2, 3
ENTRANCE_OFFSET, ENTRANCE_EPS = 3.0, 12.0

# Raster cost and circuit
COST_FACTOR, OBSTACLE, MIN_SPEED = 0.5, 1e9, 1e-6
BLOCKED_COST, MIN_COST, MIN_CONDUCTANCE = 1e8, 1e-6, 1e-12
MAX_CELLS, MAX_PAIRS = 250_000, 50
SNAP_RADIUS, DOOR_SNAP = 14, 5

# Spectral
# Absolute calibration factors and effective bandwidths of the eight bands, in the order coastal, blue, green, yellow, red, red edge, NIR1, NIR2 (fixed values; public sensor calibration)
ABSCAL = (9.295654e-03, 1.783568e-02, 1.364197e-02, 6.810718e-03, 1.851735e-02, 6.063145e-03, 2.050828e-02, 9.042234e-03)
EFF_BW = (4.73e-02, 5.43e-02, 6.30e-02, 3.74e-02, 5.74e-02, 3.93e-02, 9.89e-02, 9.96e-02)
BANDS = ("coastal", "blue", "green", "yellow", "red", "rededge", "nir1", "nir2")
NORM_PCT, NORM_EPS = (0.02, 0.98), 1e-9
MATERIAL = (25.0, 0.08, 0.60, 0.40)
SIGNAL_WEIGHTS = {"gabor": 0.40, "material": 0.30, "coherence": 0.15, "stability": 0.15}
SIGNAL_MIN, OBJECT_MIN, SEGMENT_MIN, HULL_BUFFER = 0.45, 50, 10, 15.0
GABOR_FREQ = {0.15: 0.25, 0.25: 0.45, 0.40: 0.30}
COMPONENT_WEIGHTS = (0.55, 0.30, 0.15)
CLASS_NAMES = {3: "shadow_alley", 6: "shaded_compacted", 4: "bright_anomaly"}
CLASS_DEFAULT = "desert_sand"

# Scoring
SCORE_WEIGHTS = {"spec": 0.40, "stab": 0.15, "betw": 0.25, "circ": 0.20}
CONFIDENCE_HIGH, CONFIDENCE_MODERATE = 0.60, 0.40
DISCOVERY_DIST, DISCOVERY_LENGTH, DISCOVERY_SIGNAL = 15.0, 25.0, 0.35
SKELETON_WEIGHTS = (0.70, 0.30)
DISCOVERY_WEIGHTS = (0.50, 0.30, 0.20)
AGREE_DIST, AGREE_SHARE = 12.0, 0.60
SAMPLE_STEP = 2.0
