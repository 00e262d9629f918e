"""Row types of the tables that flow between the jobs."""

RAW_PACKET_DDL = "file string, seq bigint, ts_sec bigint, ts_usec int, caplen int, data binary, start_time double"

ARRAY_EVENT_DDL = (
    "file string, event bigint, telescope int, tel_event int, scope_id int, "
    "pcap_time double, pix array<smallint>"
)
PEDESTAL_DDL = "file string, scope_id int, peds array<double>, pedvars array<double>"
CORRECTION_DDL = (
    "night string, telescope int, file_time_from int, file_time_to int, t_initial double, "
    "x_initial double, y_initial double, vx double, vy double, rotation_deg double"
)
SIM_PHOTON_DDL = "event bigint, telescope int, cx double, cy double"
SIM_TRUTH_DDL = "event bigint, energy double, az double, ze double, xcore double, ycore double"
SIM_TELESCOPE_DDL = "event bigint, telescope int, x double, y double, z double"

# fixed values: names and order of the columns of parameter files
SHAPE_COLUMNS = [
    "MeanX", "StdX", "MeanY", "StdY", "Phi", "Size", "Length", "Width",
    "Miss", "Distance", "Azwidth", "Alpha",
]
RECO_COLUMNS = ["Az", "Ze", "Xcore", "Ycore", "stdP"]
TRUTH_COLUMNS = ["TrueAz", "TrueZe", "TrueXcore", "TrueYcore", "TrueEnergy"]

DATA_COLUMNS = ["Event", "Telescope", "Timestamp", *SHAPE_COLUMNS]
SIM_COLUMNS = ["Event", "Telescope", *SHAPE_COLUMNS, *TRUTH_COLUMNS]
SIM_RECO_COLUMNS = ["Event", "Telescope", *SHAPE_COLUMNS, *RECO_COLUMNS, *TRUTH_COLUMNS]

# a row without any of these describes no usable image
REQUIRED_COLUMNS = ["Length", "Width", "Miss", "Distance", "Azwidth", "Alpha"]
