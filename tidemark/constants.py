"""Values that results depend on."""

# Study area, limits, bin edges, cut-offs, angles and units.
WEST, EAST, SOUTH, NORTH = 121.4, 123.2, 29.7, 31.5
MAX_SPEED_KN = 40.0
MAX_JUMP_KMH = 50.0 * 1.852
CLEAN_MARGIN_DEG = 0.3
SPEED_EDGES = (0.0, 0.5, 2.0, 5.0, 8.0, 12.0, 16.0, 25.0, 40.0)
ANCHORED_KN, UNDERWAY_KN, CONGESTED_KN = 0.5, 3.0, 3.0
SECTORS = 16
KN_TO_MS = 0.5144444
M_PER_DEG = 111194.92664455873
M_PER_NM = 1852.0
BUCKET_S = 600
DCPA_NM, LOOKAHEAD_MIN, COARSE_NM, MIN_NM = 1.0, 30.0, 6.0, 0.1
SEVERE_NM, OVERLAP_NM = 0.3, 0.05
BEAM_BACK_DEG, OVERTAKE_DEG, FORWARD_DEG, TOLERANCE_DEG = 22.5, 112.5, 67.5, 22.5
FUJII_A, FUJII_B = 4.0, 1.6
GOODWIN_AHEAD, GOODWIN_STARBOARD, GOODWIN_PORT = 0.85, 0.70, 0.45
ROT_MAX_GAP_S, ROT_MANEUVER, ROT_STEADY, ROT_WINDOW_MIN = 600, 3.0, 0.5, 15
KDE_KM_PER_DEG, KDE_NM_PER_KM = 111.19, 1 / 1.852
EARTH_KM = 6371.0
HEADWAY_EDGES_NM = (0.0, 0.05, 0.1, 0.2, 0.5)
BARRIER = ((122.0, 30.8), (123.0, 30.8))
OTHER_TYPE, UNKNOWN_TYPE, ANCHORED, UNDERWAY = "other", "unknown", "anchored", "underway"
