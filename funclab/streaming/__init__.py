"""File streams for the row-wise operators."""
