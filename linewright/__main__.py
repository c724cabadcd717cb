"""python -m linewright SOURCE TARGET [options]"""

from linewright.plans.batch import main

if __name__ == "__main__":
    main()
