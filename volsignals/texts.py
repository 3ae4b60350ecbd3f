"""Result texts, labels and text formats, as users of the reports know them."""

# screens
GHOST_TOWN = "Ghost Town - Zero volume for 3 days"
STUCK = "Price stuck at floor/ceiling"
LOW_VOLUME = "Low volume: %d"
PASSED = "All filters passed"
NO_DATA = "No data available"
NO_DATA_FOR_DATE = "No data for date %s"
PENNY_TRAP = "Penny trap - large capital, no movement"

# score reasons
HIGH_RVOL = "High RVOL (%.1fx)"
QUIET = "Quiet Accumulation (RVOL %.1fx, Price Change %.2f%%)"
LOW_FLOAT = "Low Float (%.1f Cr)"
ABOVE_SMA = "Above 200 SMA"
BELOW_SMA = "Below 200 SMA"

# exit rules
STOP_ACTION = "SELL NOW ❌"
TRAIL_ACTION = "SELL NOW 💰"
CLIMAX_ACTION = "SELL HALF ⚠️"
HOLD_ACTION = "HOLD ✅"
STOP_REASON = "EMERGENCY BRAKE: Hit -7% stop loss limit"
TRAIL_REASON = "TRAILING STOP: Dropped 5%% from peak of %.2f. Trend broken."
CLIMAX_REASON = "CLIMAX DETECTED: RVOL %.1fx with red/doji candle. Possible dump."

# sources
CSV_SOURCE = "adjusted_data"
VENDOR_A_SOURCE = "bdshare"
VENDOR_B_SOURCE = "stocksurferbd"
DEFAULT_START = "2022-11-14"
