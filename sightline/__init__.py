"""Exposure measurement from mobile-location data, as DataFrame -> DataFrame functions."""
