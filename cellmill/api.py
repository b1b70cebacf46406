"""The public names in one place."""

from cellmill.functions.crs import CRS
from cellmill.functions.filters import FilterSpec, Predicate
from cellmill.functions.grid import BBox, GridSpec
from cellmill.functions.reductions import CustomReduction, Reduction
from cellmill.operators.glyphs import GlyphSpec, custom_glyph, gaussian_glyph, gaussian_splat, line_glyph, line_splat, splat
from cellmill.operators.raster import fill, from_numpy, overview, overview_levels, pyramid, raster_diff, raster_stats, strided, to_dense, to_numpy, valid_mask
from cellmill.operators.reduce import finalize_states, merge_states, partial_states, reduce_points, tile_batches, tile_counts
from cellmill.plans.pipeline import Pipeline, PipelineConfig, ProgressInfo
from cellmill.sources.binary import CloudReader, read_binary, read_header, write_binary, write_cloud
from cellmill.sources.geotiff import GeoTiffOptions, TiledGeoTiffWriter, read_geotiff, read_geotiff_band, read_geotiff_info, write_geotiff
from cellmill.sources.las import read_las, read_las_header, write_las
from cellmill.sources.points import combined_bbox, csv_info, detect_format, from_arrays, from_dataframe, open_points, read_csv, read_points, write_csv
from cellmill.streaming.ingest import ingest_stream, live_cells, read_stream, windowed_cells
from cellmill.streaming.state import StateStore

__all__ = [name for name in dir() if not name.startswith("_")]
