"""Registry of the published layouts."""

from holdwright.sources.layouts.blocks import BLOCKS_MULTI, BLOCKS_SINGLE
from holdwright.sources.layouts.common import Layout
from holdwright.sources.layouts.flat import FLAT_11, FLAT_16, FLAT_16_TOTALS
from holdwright.sources.layouts.schedule import SCHEDULE_14, SECTION_14
from holdwright.sources.layouts.shared import SHARED_24, SHARED_24_VARIANT

LAYOUTS: dict[str, Layout] = {
    layout.key: layout
    for layout in (FLAT_11, FLAT_16, FLAT_16_TOTALS, SHARED_24, SHARED_24_VARIANT, SCHEDULE_14, SECTION_14, BLOCKS_MULTI, BLOCKS_SINGLE)
}
