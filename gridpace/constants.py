"""Fixed values the results depend on."""

# Seasons per split.
TRAIN_YEARS = (2021, 2022, 2023)
DEV_YEARS = (2024,)
TEST_YEARS = (2025,)

# Compounds, in lattice order.
DRY = ("SOFT", "MEDIUM", "HARD")
OFFSET_COMPOUNDS = ("SOFT", "HARD")  # MEDIUM is the reference

# Venues known under two names.
CIRCUIT_ALIASES = {
    "Monte Carlo": "Monaco",
    "Miami Gardens": "Miami",
    "Yas Marina": "Yas Island",
}

# Lap scale and fuel.
REF_LAP = 90.0
START_FUEL_KG = 100.0
DEFAULT_TRACK_TEMP = 35.0

# Tyre-age knots of the piecewise-linear wear curve.
KNOTS = (0, 4, 10, 18, 28, 40)

# Prior standard deviations, seconds per 90 s lap.
PRIOR_SD = {
    "fe": 1e3, "off_g": 1e3, "fuel": 1e3,
    "off_circ": 0.35, "off_race": 0.35,
    "deg0": 1.0, "deg": 0.08, "temp": 0.02,
    "deg_circ": 0.03, "deg_race": 0.03, "deg_drv": 0.01,
    "cold": 1.0, "traffic": 1.0, "early": 1.0,
}
# In-race refit settings.
IN_RACE_DEG_SD = 0.01
IN_RACE_HALF_LIFE = 5.0
FIRST_PASS_SIGMA = 0.6

# Decision lattice.
GREEN, SC, VSC = 0, 1, 2
BIG = 1e5
CLIFF = 0.05
SC_RATIO_EFF = 0.5
AGE_MARGIN = 45  # the lattice holds ages 0 .. race_laps + 45

# A (race, driver) lap series longer than this is scanned in blocks of this
# many laps, so no window partition ever holds more than one block.
BLOCK_LAPS = 4096

# Laps that a task sorts at once where tables are dealt by race.
PART_LAPS = 1 << 17
