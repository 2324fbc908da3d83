"""DataFrame -> DataFrame operators (explicit keys and order, no actions inside;
``forecast.fit_linear``'s small solve is the one documented exception)."""
