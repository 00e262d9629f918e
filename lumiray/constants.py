"""Fixed values of the instruments and of the analysis, stated once."""

import math

# --- camera (fixed values) -------------------------------------------------
CAMERA_SIDE = 32
CAMERA_MIN_DEG = -4.95
CAMERA_MAX_DEG = 4.95
PIXEL_DEG = (CAMERA_MAX_DEG - CAMERA_MIN_DEG) / CAMERA_SIDE

# --- aperture cleaning (fixed values) --------------------------------------
SUBPIXELS = 5
APERTURE_RADIUS = 2
# share of a unit square at offset (|dx|, |dy|) covered by a circle of radius 2
APERTURE_OVERLAP = {
    (0, 0): 1.0,
    (0, 1): 1.0,
    (1, 0): 1.0,
    (1, 1): 0.984969,
    (0, 2): 0.478967,
    (2, 0): 0.478967,
    (1, 2): 0.198797,
    (2, 1): 0.198797,
    (2, 2): 0.0,
}
READOUT_NOISE_ADU = 10.0
SNR_THRESHOLD = 7.0
NSB_DATA_ADU = 1.0
NSB_SIM_ADU = 16 * 0.06
MIN_IMAGE_PIXELS = 3

# --- simulation (fixed values) ---------------------------------------------
ADU_PER_PHOTON = 16
TRIGGER_ADU = 6.5 * 16
MAGNETIC_DECLINATION_DEG = 12.77

# --- telescopes (fixed values): id -> x, y, z in metres ---------------------
TELESCOPES = (1, 2, 3)
DATA_TELESCOPES = {
    1: (80.48, 53.59, 0.0),
    2: (-6.95, -107.18, 0.0),
    3: (-73.52, 53.59, 0.0),
}
SIM_TELESCOPES = {
    1: (-101.35, -42.32),
    2: (-25.29, 84.64),
    3: (126.65, -42.32),
}

# --- capture payload (fixed values) ----------------------------------------
SCIENCE_CAPLEN = 570
PAYLOAD_OFFSET = 42
PACKET_PIXELS = 256

# --- pointing corrections of one observing night (fixed values) -------------
# night, telescope, file time from (incl.), to (excl.), t0, x0, y0, vx, vy, rotation
POINTING_CORRECTIONS = (
    ("1030", 1, 0, 110000, 1730276185.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ("1030", 2, 0, 110000, 1730275403.0, 0.0, 0.0, -1.987e-4, 0.0, 90.0),
    ("1030", 3, 0, 110000, 1730282071.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ("1030", 1, 110000, 240000, 1730286027.0, -1.0, 0.0, 0.0, 0.0, 180.0),
    ("1030", 2, 110000, 113600, 1730286555.0, 4.0, 0.0, 0.0, 0.0, 180.0),
    ("1030", 2, 113600, 240000, 1730288167.0, 0.0, 0.0, 0.0, 0.0, 180.0),
    ("1030", 3, 110000, 240000, 1730287607.0, 0.0, 0.0, 0.0, -2.139e-4, 180.0),
    ("1031", 1, 0, 240000, 1730359112.0, 0.0, 1.0, 5.359e-4, 0.0, 0.0),
    ("1031", 2, 0, 240000, 1730359099.0, 1.0, 0.0, 0.0, 0.0, 0.0),
    ("1031", 3, 0, 240000, 1730359112.0, 1.0, 0.0, -2.975e-4, 0.0, 0.0),
    ("1101", 1, 0, 110000, 1730447174.0, 0.0, 0.0, 1.013e-3, 2.533e-4, 0.0),
    ("1101", 2, 0, 110000, 1730447174.0, 0.0, 0.0, 0.0, 9.193e-5, 0.0),
    ("1101", 3, 0, 110000, 1730447174.0, 0.0, 0.0, -2.058e-4, 0.0, 0.0),
    ("1101", 1, 110000, 240000, 1730459429.0, 0.0, 0.0, -8.239e-4, 2.060e-4, 180.0),
    ("1101", 2, 110000, 240000, 1730458800.0, 0.0, 0.0, 0.0, 0.0, 180.0),
    ("1101", 3, 110000, 240000, 1730458800.0, 0.0, 0.0, 0.0, 0.0, 180.0),
)

# --- sky map (fixed values) --------------------------------------------------
POINTING = "05 44 32 +22 01 03"
POINTING_RA_DEG = 15.0 * (5 + 44 / 60 + 32 / 3600)
POINTING_DEC_DEG = 22 + 1 / 60 + 3 / 3600
ON_REGION = (83.632417, 22.017389)
MAP_HALF_WIDTH_DEG = 5.0
MAP_STEP_DEG = 0.2
MAP_BINS = 50
THETA_CUT_DEG = 0.32214
MAX_DISTANCE_CUT_DEG = 2.0
OFF_FIRST_BIN = 5
OFF_BIN_SKIP = 4
OFF_BINS_PER_AXIS = 11
OFF_BUFFER_DEG = 1.4

# --- histograms of image parameters (fixed values): lo, hi, bins ---------------
PARAMETER_RANGES = {
    "Length": (0.0, 2.0, 80),
    "Width": (0.0, 1.0, 80),
    "Miss": (0.0, 3.0, 80),
    "Distance": (0.0, 6.0, 80),
    "Log10Size": (2.0, 5.0, 80),
    "Alpha": (0.0, 90.0, 80),
}
CENTROID_HALF_RANGE_DEG = 4.96

# --- selection scans and effective area (fixed values) -------------------------
SCAN_STEPS = 10000
MAX_DISTANCE_SCAN_DEG = 3.0
THETA_SCAN_DEG = 1.0
THROW_AREA_KM2 = math.pi * 0.4 * 0.4
CLASSIFIER_TREES = 200
CLASSIFIER_DEPTH = 50
TRAIN_PERCENT = 67
EARTH_RADIUS_M = 6371000.0

# sums of doubles closer to zero than this are rounding noise: a width from such a variance is written
# as 0.000000 in parameter files in any case
NOISE = 2e-13

# frame of a shower and core on the ground (fixed values): smallest tilt, coordinate and direction cosine that are not
# zero, and the range of numbers of single precision
LEAST_TILT = 1e-9
LEAST_LENGTH = 1e-5
LEAST_COSINE = 1e-7
SINGLE_MIN, SINGLE_MAX = 1.1754943508222875e-38, 3.4028234663852886e38
