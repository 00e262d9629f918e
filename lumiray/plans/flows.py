"""The three long jobs of the analysis, composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiray import constants as K
from lumiray.operators import images as I
from lumiray.operators import parameters as P
from lumiray.operators import pointing, quality, sky, stereo
from lumiray.schemas import RECO_COLUMNS, SHAPE_COLUMNS, SIM_RECO_COLUMNS, TRUTH_COLUMNS


def data_parameters(events: DataFrame, pedestals: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Array events to the parameter table: pedestals, cleaning, pointing, moments.

    Images stay whole rows from scan to parameters, so nothing is shuffled; only the
    small pedestal and correction tables travel. With corrections, `events` carries
    night and file_time.
    """
    cleaned = I.clean_images(I.subtract_pedestals(events, pedestals), K.NSB_DATA_ADU).drop("pix")
    if corrections is not None:
        cleaned = pointing.with_offsets(pointing.attach_corrections(cleaned, corrections))
    params = P.image_parameters(P.raw_moments_from_images(cleaned))
    return params.select("file", "Event", "Telescope", F.col("pcap_time").alias("Timestamp"), *SHAPE_COLUMNS)


def sim_images(photons: DataFrame, truth: DataFrame, weight=None) -> DataFrame:
    """Simulated photons to cleaned array images of the triggered telescopes."""
    pixels = I.bin_photons(I.project_photons(photons, truth), weight)
    fired = I.trigger_images(I.images_from_pixels(pixels))
    return I.clean_images(fired, K.NSB_SIM_ADU)


def reconstruct(
    params: DataFrame, truth: DataFrame, positions=None, telescopes=K.TELESCOPES, unique_images: bool = False,
    parallel: float = 0.0,
) -> DataFrame:
    """Per event direction (Az, Ze) and ground position, with the fit quality.

    `truth` has Event, TrueAz, TrueZe; telescope positions as in `stereo.core_lines`. An event may have any
    number of images; `unique_images` says that it has at most one of each of `telescopes`.
    `parallel`: weighted mean squared sine of the crossing angles up to which lines have no core; by
    default only exactly parallel ones.
    """
    images = stereo.reconstructible(params)
    if unique_images:
        wide = stereo.side_by_side(images, telescopes=telescopes)
        directed = stereo.axis_intersection(wide.filter("n_images >= 2"), telescopes)
        return stereo.core_reconstruction(stereo.with_azze(directed.join(truth, "Event")), positions, telescopes, parallel)
    if positions is None:
        raise ValueError("telescope positions are needed where telescopes may repeat")
    aimed = stereo.with_azze(stereo.directions_of_pairs(images).join(truth, "Event"))
    fitted = stereo.core_of_images(images, aimed, positions, parallel)
    placed = stereo.core_to_ground(fitted).select("Event", "xfit", "yfit", "stdP", "n_lines", "core_valid", "Xcore", "Ycore")
    # a direction stays where no image gives a line
    return aimed.join(placed, "Event", "left")


def sim_parameters(
    params: DataFrame, truth: DataFrame, positions=None, reconstruct_events: bool = True, telescopes=K.TELESCOPES,
    unique_images: bool = False, parallel: float = 0.0,
) -> DataFrame:
    """The simulation parameter table: every image, once for each time it is there, with its event's
    truth and, where it could be reconstructed, direction and core. Images without truth stay, with NULL."""
    truth = truth.select("Event", *TRUTH_COLUMNS)
    rows = params.select("Event", "Telescope", *SHAPE_COLUMNS).join(truth, "Event", "left")
    if not reconstruct_events:
        return rows
    events = reconstruct(params, truth.select("Event", "TrueAz", "TrueZe"), positions, telescopes, unique_images, parallel)
    return rows.join(events.select("Event", *RECO_COLUMNS), "Event", "left").select(*SIM_RECO_COLUMNS)


def sky_events(
    params: DataFrame, sky_map: sky.SkyMap = sky.SkyMap(), least: int = 2, dedupe: bool = True, unique_images: bool = False
) -> DataFrame:
    """Parameter table to events on the sky: quality, copies, width, then directions.

    Multiplicity needs no pass of its own. `unique_images` says that no event has two images of a telescope."""
    rows = quality.drop_missing(params)
    if dedupe:
        rows = quality.dedupe_for_sky(rows)
    rows = quality.positive_width(rows)
    directed = stereo.directions(rows, least, sky_map.telescopes, unique=unique_images)
    if not unique_images:
        # the list holds one event's images
        spots = rows.groupBy("Event").agg(F.collect_list(F.struct("MeanX", "MeanY")).alias("images"))
        directed = directed.join(spots, "Event")
    return sky.image_positions(directed, sky_map)
